"""Model calls with injected functions: embedding, map-reduce summaries, a unigram tokenizer, audio.

No weights are bundled. A caller passes functions from texts to results; each runs in Arrow
batches on the executors, and a factory loads its model once per worker.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import META, ws_trim

WINDOW, ROUNDS = 3000, 6


def embed(texts: DataFrame, factory: Callable[[], Callable[[list[str]], np.ndarray]], text_col: str = "text", batch: int = 64) -> DataFrame:
    """Add vector: the model's output for each text that isn't blank, scaled to unit length; blank texts are left out."""
    rows = texts.filter(ws_trim(F.coalesce(F.col(text_col), F.lit(""))) != "")
    names = [c for c in rows.columns if c != "vector"]
    from pyspark.sql import types as T

    schema = T.StructType([*(rows.schema[c] for c in names), T.StructField("vector", T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = factory()
        for whole in batches:
            for start in range(0, whole.num_rows, batch):
                part = whole.slice(start, batch)
                x = np.asarray(model(part.column(part.schema.get_field_index(text_col)).to_pylist()), np.float64)
                x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(names))), pa.array(x.astype(np.float32).tolist(), pa.list_(pa.float32()))], names=[*names, "vector"])

    return rows.select(*names).mapInArrow(run, schema)


def split_for(text: str, measure: Callable[[str], int], limit: int) -> list[str]:
    """A part that is too long, by sentences, and where one is still too long, in halves at a space beyond a quarter."""
    if measure(text) <= limit or len(text) < 2:
        return [text]
    from ..sources.captions import split_sentences

    pieces = split_sentences(text)
    if len(pieces) > 1:
        return pack([q for p in pieces for q in split_for(p, measure, limit)], measure, limit, " ")
    half = len(text) // 2
    space = text.rfind(" ", 0, half + 1)
    at = space if space > len(text) // 4 else half
    return [q for p in (text[:at].strip(), text[at:].strip()) if p for q in split_for(p, measure, limit)]


def pack(parts: list[str], measure: Callable[[str], int], limit: int, glue: str = "\n\n") -> list[str]:
    """Parts joined greedily as long as they measure ``limit`` at most; longer ones are split first."""
    out: list[str] = []
    for p in parts:
        for q in [p] if measure(p) <= limit else split_for(p, measure, limit):
            if out and measure(out[-1] + glue + q) <= limit:
                out[-1] += glue + q
            else:
                out.append(q)
    return out


_meta = re.compile(META.replace("(?iu)", "(?i)")).search


def retried(generate: Callable[[str, str], str], mode: str, text: str) -> str:
    """The generator's answer; one more try if it is blank or talks about the task, then an error."""
    for _ in range(2):
        answer = (generate(mode, text) or "").strip()
        if answer and not _meta(answer):
            return answer
    raise ValueError("the generator gave no summary")


def summarize_text(parts: list[str], generate: Callable[[str, str], str], measure: Callable[[str], int] = lambda t: len(t.split()), window: int = WINDOW) -> str:
    """Section notes per packed window, reduced until one is left (ROUNDS rounds at most), then the summary."""
    notes = [retried(generate, "section", p) for p in pack([p for p in parts if p.strip()], measure, window)]
    for _ in range(ROUNDS):
        if len(notes) <= 1:
            break
        notes = [retried(generate, "reduction", p) for p in pack(notes, measure, window)]
    return retried(generate, "summary", "\n\n".join(notes)) if notes else ""


def summarize(docs: DataFrame, factory: Callable[[], Callable[[str, str], str]], parts_col: str = "parts", id_col: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """One summary per document from an array of its parts; documents are independent, so each is reduced where it lies."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        generate = factory()
        for b in batches:
            out = [summarize_text([p for p in parts or () if p], generate, window=window) for parts in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["_id", "summary"])

    return docs.select(id_col, parts_col).mapInArrow(run, f"_id {kind}, summary string").withColumnRenamed("_id", id_col)


class Unigram:
    """A unigram tokenizer: the best path over pieces of at most ``longest`` characters, bytes where no piece fits."""

    def __init__(self, scores: dict[str, float], longest: int = 64) -> None:
        self.scores, self.longest = scores, min(longest, max(map(len, scores), default=1))
        self.unknown = min(scores.values(), default=0.0) - 10.0

    def pieces(self, text: str) -> list[str]:
        text = "▁" + text.replace(" ", "▁")
        best = [0.0] + [-np.inf] * len(text)
        back = [0] * (len(text) + 1)
        for k in range(len(text)):
            for e in range(k + 1, min(len(text), k + self.longest) + 1):
                s = self.scores.get(text[k:e])
                if s is None and e == k + 1:
                    s = self.unknown
                if s is not None and best[k] + s > best[e]:
                    best[e], back[e] = best[k] + s, k
        out, at = [], len(text)
        while at:
            piece = text[back[at] : at]
            out += [piece] if piece in self.scores else [f"<0x{b:02X}>" for b in reversed(piece.encode())]
            at = back[at]
        return out[::-1]


def wav(samples: list[float] | np.ndarray, rate: int) -> bytes:
    """Mono 16-bit PCM of samples clamped to -1 .. 1."""
    x = np.clip(np.asarray(samples, np.float64), -1, 1)
    data = np.where(x < 0, x * 0x8000, x * 0x7FFF).astype("<i2").tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate * 2, 2, 16) + b"data" + struct.pack("<I", len(data)) + data


def faded(samples: np.ndarray, rate: int, seconds: float = 0.005) -> np.ndarray:
    """Linear fades at both ends."""
    out = np.array(samples, np.float32)
    n = min(len(out) // 2, int(rate * seconds))
    if n:
        ramp = np.arange(n, dtype=np.float32) / n
        out[:n] *= ramp
        out[-n:] *= ramp[::-1]
    return out


def ink_bounds(pixels: np.ndarray, white: int = 248) -> tuple[int, int, int, int] | None:
    """Box (x1, y1, x2, y2) of the pixels darker than white in a grey image; none if blank."""
    rows, columns = np.flatnonzero((pixels < white).any(1)), np.flatnonzero((pixels < white).any(0))
    return None if not len(rows) else (int(columns[0]), int(rows[0]), int(columns[-1]) + 1, int(rows[-1]) + 1)
