"""BPE encoding and decoding through a pair occurrence index.

The distinct words not met before in a task are laid out in one symbol list. An index maps the
rank of each mergeable pair to all its positions; ranks are taken in ascending order, each
applied at all its positions, and the lists of the pairs that arise beside them are updated.
Words are then reused from a cache of bounded size, so memory doesn't grow with the input.

The tokenizer file is a parameter. Its content is broadcast (a vocabulary file, not data).
Supported: the normalizers NFC, whitespace folding and lower case, in this order, a split by pattern
into words without white space, byte-level symbols, an end-of-word suffix, special tokens taken from
the raw text, and no decoder, which joins tokens by spaces. A file that asks for anything else is
refused with a ValueError.

Defined cases: a null text is empty and gives no ids; extra columns stay unless their names are
those of the columns added; an empty table gives no rows. Texts are encoded whole, a few million
characters at a time.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ._spark import small_batches, tidy

#: Words and space-separated chunks kept by a worker, and characters and words laid out at once.
CACHE_WORDS, CACHE_CHUNKS, BATCH_CHARS, BATCH_WORDS = 200_000, 250_000, 1_000_000, 4_000
#: str.split takes these for white space, the tokenizer doesn't.
SEPARATORS = re.compile("[\x1c-\x1f]").search


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table, free = {b: chr(b) for b in plain}, 0x100
    for b in range(256):
        if b not in table:
            table[b], free = chr(free), free + 1
    return [table[b] for b in range(256)]


#: What a file may ask for, besides its pattern, vocabulary, merges, suffix and special tokens.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {"type": "Split", "behavior": "Removed", "invert": True}
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}


def refuse_unsupported(spec: dict) -> None:
    """Raise a ValueError that names what of a tokenizer file this encoder would get wrong."""
    wrong = []
    model = spec["model"]
    if model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges")):
        wrong.append("model")
    if spec.get("normalizer") != NORMALIZER:
        wrong.append("normalizer")
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
    fits = len(steps) == 2 and all(steps[0].get(k) == v for k, v in SPLIT.items()) and all(steps[1].get(k) == v for k, v in BYTES.items())
    pattern = steps[0].get("pattern", {}).get("Regex") if fits else None
    if pattern is None or any(re.search(r"\s", w) for w in regex.findall(pattern, "a b  1 2\n'! ?\t. it's \u00a0x")):
        wrong.append("pre_tokenizer")
    if spec.get("decoder") is not None:
        wrong.append("decoder")
    if any(t.get(k) for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
        wrong.append("added_tokens")
    if wrong:
        raise ValueError(f"this tokenizer file's {', '.join(wrong)} isn't supported")


class Recent:
    """Values of the keys met last, ``most`` or those of one batch, in two dicts. When the younger is half full it becomes
    the older; keys met again move on, so frequent ones stay whatever the number of rare ones."""

    def __init__(self, most: int) -> None:
        self.most, self.young, self.old = most, {}, {}

    def __len__(self) -> int:
        return len(self.young) + len(self.old)

    def missing(self, keys: set[str]) -> set[str]:
        """The keys without a value; those of all others are in ``young`` afterwards."""
        out = keys - self.young.keys()
        again = out & self.old.keys()
        moved = {k: self.old[k] for k in again}
        if len(self.young) + len(out) > self.most // 2:
            moved.update((k, self.young[k]) for k in keys - out)
            self.old, self.young = self.young, moved
        else:
            self.young |= moved
        out -= again
        if len(self) + len(out) > self.most:
            self.old = {}
        return out

    def clear(self) -> None:
        self.young, self.old = {}, {}


class Bpe:
    """A byte-level BPE tokenizer with word ends, read from a tokenizer file's content."""

    def __init__(self, content: bytes) -> None:
        spec = json.loads(content)
        refuse_unsupported(spec)
        model, suffix = spec["model"], spec["model"].get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.tokens = [""] * (1 + max([*self.vocab.values(), *(t["id"] for t in spec["added_tokens"])]))
        for token, i in self.vocab.items():
            self.tokens[i] = token
        for t in spec["added_tokens"]:
            self.tokens[t["id"]] = t["content"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.merges: list[tuple[int, int, int]] = []
        self.ranks: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.append((self.vocab[a], self.vocab[b], self.vocab[a + b]))
            self.ranks[self.vocab[a], self.vocab[b]] = rank
        symbols = byte_symbols()
        self.inner = [self.vocab.get(s, -1) for s in symbols]
        self.final = [self.vocab.get(s + suffix, -1) for s in symbols]
        self.split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        # of special tokens that begin alike the longest is taken
        names = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, names)) + ")").split if names else None
        self.cache, self.chunks = Recent(CACHE_WORDS), Recent(CACHE_CHUNKS)

    def holds_special(self, text: str) -> bool:
        return any(t in text for t in self.special)

    def words(self, text: str) -> list[str]:
        """Normalised words; special tokens stand among them as they are, after a NUL that no word begins with."""
        if not self.holds_special(text):
            return self._words(text)
        out: list[str] = []
        for k, part in enumerate(self.cut(text)):
            if k % 2:
                out.append("\0" + part)
            elif part:
                out += self._words(part)
        return out

    def _words(self, text: str) -> list[str]:
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return self.split(text)

    def merge(self, words: list[str]) -> list[bytes]:
        """The ids of each word as little-endian unsigned 32-bit integers, by the pair occurrence index."""
        sym: list[int] = [-1]
        starts = []
        for w in words:
            raw = w.encode()
            starts.append(len(sym))
            sym += [i for i in (*(self.inner[b] for b in raw[:-1]), self.final[raw[-1]]) if i >= 0]
            sym.append(-1)
        n = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks, merges = self.ranks, self.merges
        index: dict[int, list[int]] = {}
        for p in range(1, n - 1):
            r = ranks.get((sym[p], sym[p + 1]))
            if r is not None:
                index.setdefault(r, []).append(p)
        heap = list(index)
        heapq.heapify(heap)
        while heap:
            rank = heapq.heappop(heap)
            places = index.pop(rank, None)
            if places is None:
                continue
            places.sort()
            a, b, new = merges[rank]
            for k, p in enumerate(places):
                if sym[p] != a:
                    continue
                q = after[p]
                if sym[q] != b:
                    continue
                sym[p], sym[q] = new, -2
                nxt, prv = after[q], before[p]
                after[p], before[nxt] = nxt, p
                sooner = False
                for at, pair in ((prv, (sym[prv], new)), (p, (new, sym[nxt]))):
                    r = ranks.get(pair)
                    if r is not None:
                        if r in index:
                            index[r].append(at)
                        else:
                            index[r] = [at]
                            heapq.heappush(heap, r)
                        sooner |= r < rank
                if sooner:  # a token can arise by several merges, so a pair beside it may rank before this one
                    rest = places[k + 1 :]
                    if rest:
                        if rank in index:
                            index[rank] += rest
                        else:
                            index[rank] = rest
                            heapq.heappush(heap, rank)
                    break
        out = []
        for s in starts:
            ids, p = array("I"), s
            while sym[p] >= 0:
                ids.append(sym[p])
                p = after[p]
            out.append(ids.tobytes())
        return out

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text. No word spans white space, so texts are cut at it and each distinct chunk is encoded once."""
        split = [[t] if SEPARATORS(t) or self.holds_special(t) else t.split() for t in texts]
        new = self.chunks.missing(set().union(*split))
        self.chunks.young.update(self._encode_chunks(list(new)))
        get = self.chunks.young.__getitem__
        out = [b"".join(map(get, c)) for c in split]
        for c in split:
            if len(c) == 1 and len(c[0]) > 1000:
                self.chunks.young.pop(c[0], None)
        return out

    def _encode_chunks(self, chunks: list[str]) -> dict[str, bytes]:
        split = [self.words(c) for c in chunks]
        new = self.cache.missing(set().union(*split))
        cache = self.cache.young
        plain = []
        for w in new:
            if w[0] == "\0" and w[1:] in self.special:
                cache[w] = array("I", [self.special[w[1:]]]).tobytes()
            else:
                plain.append(w)
        for k in range(0, len(plain), BATCH_WORDS):
            part = plain[k : k + BATCH_WORDS]
            cache.update(zip(part, self.merge(part)))
        get = cache.__getitem__
        return {c: b"".join(map(get, ws)) for c, ws in zip(chunks, split)}

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_models: dict[str, Bpe] = {}


def _model(content: bytes) -> Bpe:
    key = hashlib.sha256(content).hexdigest()
    if key not in _models:
        _models.clear()
        _models[key] = Bpe(content)
    return _models[key]


def _ids_column(parts: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *(len(p) // 4 for p in parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(parts), "<u4").astype(np.int32)))


#: What can be added, its type, and how it comes from the ids and the model.
OUTPUTS: dict[str, tuple[T.DataType, pa.DataType, Callable[[Bpe, bytes], object]]] = {
    "n_tokens": (T.LongType(), pa.int64(), lambda m, ids: len(ids) // 4),
    "ids": (T.ArrayType(T.IntegerType()), pa.list_(pa.int32()), lambda m, ids: ids),
    "decoded": (T.StringType(), pa.string(), lambda m, ids: m.decode(ids)),
    "ids_sha256": (T.StringType(), pa.string(), lambda m, ids: hashlib.sha256(ids).hexdigest()),
    "decoded_sha256": (T.StringType(), pa.string(), lambda m, ids: hashlib.sha256(m.decode(ids).encode()).hexdigest()),
}


def in_batches(texts: list[str | None], chars: int = BATCH_CHARS) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about so many characters, with the place of the first."""
    start, run, size = 0, [], 0
    for k, t in enumerate(texts):
        run.append(t or "")
        size += len(run[-1])
        if size >= chars:
            yield start, run
            start, run, size = k + 1, [], 0
    if run:
        yield start, run


def encode(df: DataFrame, tokenizer: bytes, outputs: tuple[str, ...] = ("ids",), text_col: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """Add ``outputs`` (names of OUTPUTS) for each row's text; ``keep`` names the columns that stay, all by default."""
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(tokenizer)
    kept = [c for c in (df.columns if keep is None else keep) if c not in outputs]
    schema = T.StructType([*(df.schema[c] for c in kept), *(T.StructField(o, OUTPUTS[o][0]) for o in outputs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(shared.value)
        for batch in batches:
            place = batch.schema.get_field_index(text_col)
            for start, texts in in_batches(batch.column(place).to_pylist()):
                ids = model.encode_batch(texts)
                part = batch.slice(start, len(texts))
                columns = [part.column(batch.schema.get_field_index(c)) for c in kept]
                for o in outputs:
                    columns.append(_ids_column(ids) if o == "ids" else pa.array([OUTPUTS[o][2](model, x) for x in ids], OUTPUTS[o][1]))
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, *outputs])
        tidy(model.cache, model.chunks)

    return df.select(*dict.fromkeys([*kept, text_col])).mapInArrow(run, schema)


def tokenizer_content(path: str | None = None) -> bytes:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, "rb") as f:
        return f.read()


DIGESTS = ("n_tokens", "ids_sha256", "decoded_sha256")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs, tokenizer_content(), DIGESTS, keep=("doc_id",))


QUERIES = {"op8_bpe": op8_bpe}
ORACLES = {}
