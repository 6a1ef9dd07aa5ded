"""Sentence pieces with their places in the source, and back to text.

A text is normalised first: at each place the longest rule of the compiled
character map is applied, white space is treated as the model says, and for
every character that comes out the byte of the source where its rule began is
kept. Pieces are pieces of the normalised text, so the bytes where a piece
begins and where the next one does are its span in the source. A character
that falls back to bytes belongs to the last of them.

No piece has a word sign behind another character, so what stands between such
places is encoded by itself, each distinct unit once, by the library's model
without its normaliser.
"""

from __future__ import annotations

import array
import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm.tables import releasing, small_batches, table

VOCABULARY = "piece_bpe_32k.model"
#: Characters of normalised text whose units are held at once, about, and of a unit that is remembered or encoded in one go.
BLOCK_CHARS, UNIT_CHARS = 1 << 20, 64
#: Units that a worker remembers, about 150 bytes each; then it starts anew.
MEMORY = 400_000
#: Fixed values of the model's format: the sign for a space, and the numbers of fields and kinds.
SIGN = "▁"
PIECES, TRAINER, NORMALIZER = 1, 2, 3
PIECE, KIND = 1, 3
KIND_USER, KIND_BYTE = 4, 6
BPE_KIND, MODEL_KIND, SIGN_BEHIND, BYTE_FALLBACK = 2, 3, 24, 35
CHARACTER_MAP, SIGN_FIRST, FEW_SPACES, SIGNS_FOR_SPACES = 2, 3, 4, 5


def _varint(data: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        byte = data[at]
        out, shift, at = out | (byte & 127) << shift, shift + 7, at + 1
        if byte < 128:
            return out, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a protobuf message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size, at = _varint(data, at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


def read_character_map(compiled: bytes) -> dict[str, str]:
    """The rules of a compiled character map: the size of a double array, the array, and results that end with a zero byte.

    A unit of the array tells its label (lower byte; bit 31: a value instead), whether a
    value hangs on it (bit 8), and the offset of its children.
    """
    if not compiled:
        return {}
    size = int.from_bytes(compiled[:4], "little")
    units, results = np.frombuffer(compiled[4 : 4 + size], "<u4").astype(np.int64), compiled[4 + size :]
    offsets = (units >> 10) << ((units & 512) >> 6)
    rules, keys, bases, labels = {}, [b""], offsets[:1], np.arange(1, 256)
    while len(bases):  # the keys of one more byte
        at = bases[:, None] ^ labels
        found = (at < len(units)) & (units[np.minimum(at, len(units) - 1)] & 0x800000FF == labels)
        parent, child = np.nonzero(found)
        at = at[found]
        keys = [keys[p] + bytes([c + 1]) for p, c in zip(parent.tolist(), child.tolist(), strict=True)]
        bases = at ^ offsets[at]
        for k in np.flatnonzero(units[at] >> 8 & 1).tolist():
            begin = int(units[bases[k]]) & 0x7FFFFFFF
            rules[keys[k].decode()] = results[begin : results.index(0, begin)].decode()
    return rules


class Normalizer:
    """Longest-prefix rules and white space as a model has them; keeps where each character comes from."""

    def __init__(self, rules: dict[str, str], sign_first: bool, few_spaces: bool, signs: bool):
        self.rules, self.sign_first, self.few_spaces, self.sign = rules, sign_first, few_spaces, SIGN if signs else " "
        self.trie: dict = {}
        for key, value in rules.items():
            node = self.trie
            for c in key:
                node = node.setdefault(c, {})
            node[""] = value
        single = "".join(re.escape(c) for c in self.trie if "" in self.trie[c])
        longer = "".join(re.escape(c) for c in self.trie if self.trie[c].keys() - {""})
        second = "".join(re.escape(c) for c in {d for c in self.trie.values() for d in c if d})
        found = [f"[{single}]"] * bool(single) + [f"[{longer}](?=[{second}])"] * bool(longer)
        self.begins = re.compile("|".join(found)) if found else None

    def _longest(self, text: str, at: int) -> tuple[int, str] | None:
        node, out = self.trie, None
        while at < len(text) and (node := node.get(text[at])) is not None:
            at += 1
            if "" in node:
                out = at, node[""]
        return out

    def _apply(self, text: str) -> tuple[str, np.ndarray, np.ndarray]:
        """What the rules make of `text`, of which character each one comes, and whether its rule gives only spaces up to it."""
        if not self.begins:
            return text, np.arange(len(text)), _is(text, " ")
        out, sources, lead = [], [], []

        def plain(begin: int, end: int) -> None:
            out.append(text[begin:end])
            sources.append(np.arange(begin, end))
            lead.append(_is(out[-1], " "))

        done, match = 0, self.begins.search(text)
        while match:
            at = match.start()
            rule = self._longest(text, at)
            nxt = at + 1
            if rule:
                plain(done, at)
                done = nxt = rule[0]
                out.append(rule[1])
                sources.append(np.full(len(rule[1]), at))
                lead.append(np.arange(len(rule[1])) < len(rule[1]) - len(rule[1].lstrip(" ")))
            match = self.begins.search(text, nxt)
        plain(done, len(text))
        return "".join(out), np.concatenate(sources), np.concatenate(lead)

    def normalize(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its characters and for its end a byte of `text` in UTF-8."""
        if not text:
            return "", np.zeros(1, np.int64)
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        starts = np.concatenate([[0], np.cumsum(1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF))])
        made, source, lead = self._apply(text)
        first = self._skipped(text) if self.few_spaces else 0
        if first == len(text):
            return "", starts[[first]]
        if self.few_spaces:
            # A rule that gives spaces first loses them where a space stands before it.
            before = np.concatenate([[True], _is(made, " ")[:-1]])
            begins = np.flatnonzero(np.diff(source, prepend=-1))
            before = np.repeat(before[begins], np.diff(np.append(begins, len(source))))
            kept = np.flatnonzero(~(lead & before))
            if len(kept) < len(made):
                made, source = "".join(map(made.__getitem__, kept.tolist())), source[kept]
        if self.sign_first:
            made, source = " " + made, np.concatenate([[first], source])
        made, source = made.replace(" ", self.sign), np.append(source, len(text))
        if self.few_spaces:
            made = made.rstrip(self.sign)
        return made, starts[source[: len(made) + 1]]

    def _skipped(self, text: str) -> int:
        """Where the first character is that is no space, nor becomes one."""
        at = 0
        while at < len(text):
            end, made = self._longest(text, at) or (at + 1, text[at])
            if made != " ":
                break
            at = end
        return at


def _is(text: str, c: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32) == ord(c)


class Pieces:
    """A byte-pair model of the library with spans in the source."""

    def __init__(self, model: bytes):
        import sentencepiece

        fields = list(_fields(model))
        pieces = [dict(_fields(v)) for f, v in fields if f == PIECES]
        trainer = dict(_fields(b"".join(v for f, v in fields if f == TRAINER)))
        spec = dict(_fields(b"".join(v for f, v in fields if f == NORMALIZER)))
        kinds = np.array([p.get(KIND, 1) for p in pieces])
        if trainer.get(MODEL_KIND, 1) != BPE_KIND or not trainer.get(BYTE_FALLBACK) or trainer.get(SIGN_BEHIND) or (kinds == KIND_USER).any():
            raise ValueError("only byte-pair models that fall back to bytes, with word signs in front and without symbols of the user's own")
        rules = read_character_map(spec.get(CHARACTER_MAP, b""))
        self.normalizer = Normalizer(rules, bool(spec.get(SIGN_FIRST, 1)), bool(spec.get(FEW_SPACES, 1)), bool(spec.get(SIGNS_FOR_SPACES, 1)))
        # Messages that follow one another are one, and the last value of a field counts.
        plain = b"".join(bytes([f << 3, 0]) for f in (SIGN_FIRST, FEW_SPACES, SIGNS_FOR_SPACES)) + bytes([CHARACTER_MAP << 3 | 2, 0])
        self.plain = sentencepiece.SentencePieceProcessor(model_proto=model + bytes([NORMALIZER << 3 | 2, len(plain)]) + plain)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        texts = [p[PIECE].decode() for p in pieces]
        self.sizes = np.array([len(t) for t in texts])
        self.bytes = np.full(len(texts), -1)
        self.bytes[kinds == KIND_BYTE] = [int(texts[i][3:5], 16) for i in np.flatnonzero(kinds == KIND_BYTE)]
        sign = self.normalizer.sign
        usual = [t for t, k in zip(texts, kinds, strict=True) if k == 1]
        self.by_units = not any(re.search(f"[^{sign}]{sign}", t) for t in usual)
        self.units = re.compile(f"{sign}*[^{sign}]+|{sign}+")
        self.cut = re.compile(f"(?<=[^{sign}]){sign}")
        self.bonds = np.unique(np.array([ord(a) << 32 | ord(b) for t in usual for a, b in zip(t, t[1:], strict=False)], np.int64))
        self.known: dict[str, bytes] = {}

    def _sizes(self, ids: np.ndarray) -> np.ndarray:
        """The number of characters of each piece: of the bytes of a character none but the last has it."""
        byte = self.bytes[ids]
        goes_on = np.append((byte[1:] >= 0) & ((byte[1:] & 0xC0) == 0x80), False) & (byte >= 0)
        return np.where(goes_on, 0, np.where(byte < 0, self.sizes[ids], 1))

    def _parts(self, unit: str) -> list[str]:
        """A long unit, cut between characters that stand together in no piece."""
        codes = np.frombuffer(unit.encode("utf-32-le"), np.uint32).astype(np.int64)
        pairs = codes[:-1] << 32 | codes[1:]
        at = np.searchsorted(self.bonds, pairs)
        bound = self.bonds[np.minimum(at, len(self.bonds) - 1)] == pairs if len(self.bonds) else np.zeros(len(pairs), bool)
        ends = [0, *(np.flatnonzero(~bound) + 1).tolist(), len(unit)]
        return [unit[a:b] for a, b in zip(ends, ends[1:], strict=False)]

    def _encode(self, normal: str) -> np.ndarray:
        units = self.units.findall(normal) if self.by_units else [normal]
        if any(len(u) > UNIT_CHARS for u in units):
            units = [p for u in units for p in (self._parts(u) if len(u) > UNIT_CHARS else [u])]
        if len(self.known) > MEMORY:
            self.known.clear()
        known, long = self.known, {}
        fresh = [u for u in set(units) if u not in known]
        for unit, ids in zip(fresh, self.plain.encode(fresh, num_threads=1) if fresh else [], strict=True):
            (known if len(unit) <= UNIT_CHARS else long)[unit] = array.array("I", ids).tobytes()
        return np.frombuffer(b"".join([long.get(u) or known[u] for u in units] if long else map(known.__getitem__, units)), np.uint32)

    def encode(self, text: str, begin_id: bool = True, end_id: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and for each the byte of `text` in UTF-8 where its source begins and the one where it ends; begin and end ids have empty spans."""
        normal, source = self.normalizer.normalize(text)
        parts, done = [], 0
        while done < len(normal):
            # Only cut where units part; a text without such a place is one block.
            cut = self.cut.search(normal, done + BLOCK_CHARS) if self.by_units and len(normal) > done + BLOCK_CHARS else None
            end = cut.start() if cut else len(normal)
            parts.append(self._encode(normal[done:end]))
            done = end
        ids = np.concatenate([np.zeros(0, np.uint32), *parts])
        first, last = [self.library.bos_id()] * begin_id, [self.library.eos_id()] * end_id
        at = source[np.cumsum(np.concatenate([[0], [0] * len(first), self._sizes(ids), [0] * len(last)]).astype(np.int64))]
        return np.concatenate([first, ids, last]).astype(np.int64), at[:-1], at[1:]

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


@functools.cache
def pieces(model: str) -> Pieces:
    """One for each Python worker and model file."""
    with open(model, "rb") as f:
        return Pieces(f.read())


def _lists(parts: list[np.ndarray]) -> pa.Array:
    at = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(parts).astype(np.int32)))


def _encode(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = pieces(model)
        for batch in batches:
            columns = zip(*(coder.encode(text.as_py() or "") for text in batch.column(1)), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(_lists, columns)], ["doc_id", "ids", "begins", "ends"])

    return run


def _rows(lists: pa.Array) -> Iterator[np.ndarray]:
    at = lists.offsets.to_numpy()
    values = lists.values.to_numpy(zero_copy_only=False)
    return (values[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True))


def _decode(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = pieces(model)
        for batch in batches:
            digests, spans, texts = [], [], []
            for ids, begins, ends in zip(*(_rows(batch.column(k)) for k in (1, 2, 3)), strict=True):
                digests.append(hashlib.sha256(ids.astype("<u4")).hexdigest())
                spans.append(hashlib.sha256(np.stack([begins, ends], 1).astype("<u4")).hexdigest())
                texts.append(coder.decode(ids.tolist()))
            n = pa.compute.list_value_length(batch.column(1)).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n, pa.array(digests), pa.array(spans), pa.array(texts)], ["doc_id", "n_tokens", "ids_sha256", "spans_sha256", "text"])

    return run


def encode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, ids, begins and ends of every row of `docs` (doc_id, text), with begin and end ids.

    begins and ends are bytes of the UTF-8 text, the end exclusive. Null and
    empty texts have the begin and the end id alone; repeated rows stay; other
    columns are ignored. The model file lies under the same path on every machine.
    """
    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(releasing(_encode(model)), "doc_id long, ids array<int>, begins array<int>, ends array<int>")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, digests of the ids and of the spans (pairs of begin and end) as little-endian 32-bit integers, and the text that the library makes of the ids."""
    small_batches(encoded.sparkSession)
    rows = encoded.select("doc_id", "ids", "begins", "ends")
    return rows.mapInArrow(releasing(_decode(model)), "doc_id long, n_tokens long, ids_sha256 string, spans_sha256 string, text string")


def op12_sentence_pieces(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    """All rows; null and empty texts have two ids and decode to an empty text."""
    if model is None:
        import public_tokenizers

        model = public_tokenizers.path(VOCABULARY)
    out = decode(encode(table(spark, sf_dir, "documents"), model), model)
    return out.select("doc_id", "n_tokens", "ids_sha256", F.sha2("text", 256).alias("decoded_sha256"), "spans_sha256")


QUERIES = {"op12_sentence_pieces": op12_sentence_pieces}
ORACLE: dict[str, str] = {}
