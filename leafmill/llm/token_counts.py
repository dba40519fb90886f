"""Edit-aware token counts.

A document's pre-tokens are cut into leaves of LEAF pre-tokens (or chunks between single spaces); a segment tree over the
leaves holds the characters and tokens of each subtree. BPE never joins pre-tokens, so a count is
the sum over pre-tokens. An edit re-encodes from the leaf that holds the text a few characters
before it up to the first old leaf start after it at which a new pre-token starts too: from
there on all pre-tokens are the old ones. Only the touched leaves' paths to the root are updated. What
an edit makes is cut into leaves again; where it needs more leaves than it replaces, the sums are
laid out anew, without encoding anything. Trees are kept as their leaves' characters and tokens, in
two array columns, and read back from them, so that a later edit encodes its own region only.

Defined cases: a null text is empty; edits beyond the end are clipped to it, and edits apply one
after the other, each to the text that the former left; extra columns stay unless their names are
those of the columns added; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ._spark import small_batches

#: Pre-tokens of a leaf; characters before an edit on which a pre-token may depend; counts kept by a worker.
LEAF, CONTEXT, CACHE_PIECES = 64, 4, 400_000


class Counter(dict):
    """Tokens of a pre-token, encoded when first asked for."""

    def __init__(self, content: bytes, pattern: str) -> None:
        import tiktoken

        super().__init__()
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
        self.encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.pieces = regex.compile(pattern)
        self.spaced = Spaced(self)

    def __missing__(self, piece: str) -> int:
        if len(self) >= CACHE_PIECES:
            self.clear()
        n = self[piece] = len(self.encode(piece))
        return n


class Spaced(dict):
    """Tokens of a chunk without white space at its ends, after a space."""

    def __init__(self, counter: Counter) -> None:
        super().__init__()
        self.counter = counter

    def __missing__(self, chunk: str) -> int:
        if len(self) >= CACHE_PIECES:
            self.clear()
        n = sum(self.counter[p] for p in self.counter.pieces.findall(" " + chunk))
        if len(chunk) < 1000:
            self[chunk] = n
        return n


#: White space beside a space: the text's pre-tokens aren't those of its chunks between spaces.
UNEVEN = regex.compile(r"\s | \s").search


class TokenTree:
    """The segment tree of one text: ``chars`` and ``tokens`` of node k, whose children are 2k and 2k + 1."""

    def __init__(self, text: str, counter: Counter) -> None:
        self.text, self.counter, self.encoded = text, counter, 0
        if UNEVEN(text):
            pieces = counter.pieces.findall(text)
            counts, spaces = list(map(counter.__getitem__, pieces)), 0
        else:  # a lone space begins a pre-token, so the text may be cut there
            pieces = text.split(" ")
            counts, spaces = list(map(counter.spaced.__getitem__, pieces)), 1
            counts[0] = sum(counter[p] for p in counter.pieces.findall(pieces[0]))
        cuts = range(0, len(pieces), LEAF)
        parts = [pieces[k : k + LEAF] for k in cuts]
        self._plant([sum(map(len, p)) + spaces * (len(p) - (not k)) for k, p in enumerate(parts)], [sum(counts[k : k + LEAF]) for k in cuts])

    @classmethod
    def kept(cls, text: str, leaf_chars: list[int], leaf_tokens: list[int], counter: Counter) -> TokenTree:
        """The tree of a text from its kept leaves; nothing is encoded."""
        if sum(leaf_chars) != len(text) or len(leaf_chars) != len(leaf_tokens):
            raise ValueError("the kept leaves aren't this text's")
        tree = cls.__new__(cls)
        tree.text, tree.counter, tree.encoded = text, counter, 0
        tree._plant(leaf_chars, leaf_tokens)
        return tree

    def _plant(self, chars: list[int], tokens: list[int]) -> None:
        """Lay out the leaves that hold characters, and the sums above them."""
        leaves = [(c, t) for c, t in zip(chars, tokens) if c] or [(0, 0)]
        self.size = 1 << (len(leaves) - 1).bit_length()
        empty = [0] * (self.size - len(leaves))
        self.chars = [0] * self.size + [c for c, _ in leaves] + empty
        self.tokens = [0] * self.size + [t for _, t in leaves] + empty
        for k in range(self.size - 1, 0, -1):
            self.chars[k], self.tokens[k] = self.chars[2 * k] + self.chars[2 * k + 1], self.tokens[2 * k] + self.tokens[2 * k + 1]

    @property
    def leaves(self) -> tuple[list[int], list[int]]:
        return self.chars[self.size :], self.tokens[self.size :]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def leaf_at(self, offset: int) -> tuple[int, int]:
        """The leaf (as a node) that holds the offset, the last with characters if beyond, and its start."""
        k, start = 1, 0
        offset = max(0, min(offset, self.chars[1] - 1))
        while k < self.size:
            k *= 2
            if offset - start >= self.chars[k]:
                start += self.chars[k]
                k += 1
        return k, start

    def _set(self, leaf: int, chars: int, tokens: int) -> None:
        d, e = chars - self.chars[leaf], tokens - self.tokens[leaf]
        while leaf and (d or e):
            self.chars[leaf] += d
            self.tokens[leaf] += e
            leaf //= 2

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace text[start:end]."""
        old = len(self.text)
        start = max(0, min(start, old))
        end = max(start, min(end, old))
        first, begin = self.leaf_at(start - CONTEXT)
        shift = len(new) - (end - start)
        self.text = self.text[:start] + new + self.text[end:]
        last, stop = first, begin + self.chars[first]  # the old leaves to replace, and where they end in the old text
        at, made = begin, []
        for m in self.counter.pieces.finditer(self.text, begin):
            made.append((m.end() - at, self.counter[m.group()]))
            self.encoded += 1
            at = m.end()
            while stop < old and (stop < end or stop + shift < at):
                last += 1
                stop += self.chars[last]
            if stop >= end and stop + shift == at and stop < old:
                break
        else:
            last, stop = 2 * self.size - 1, old
            at = len(self.text)
        if at > begin + sum(c for c, _ in made):
            made.append((at - begin - sum(c for c, _ in made), 0))
        new = [tuple(map(sum, zip(*made[k : k + LEAF]))) for k in range(0, len(made), LEAF)]
        if len(new) <= last - first + 1:
            for k, leaf in enumerate(range(first, last + 1)):
                self._set(leaf, *(new[k] if k < len(new) else (0, 0)))
        else:
            chars, tokens = self.leaves
            a, b = first - self.size, last + 1 - self.size
            self._plant(chars[:a] + [c for c, _ in new] + chars[b:], tokens[:a] + [t for _, t in new] + tokens[b:])


_counters: dict[str, Counter] = {}


def _counter(content: bytes, pattern: str) -> Counter:
    key = hashlib.sha256(content).hexdigest() + pattern
    if key not in _counters:
        _counters.clear()
        _counters[key] = Counter(content, pattern)
    return _counters[key]


def routine_edits(text: str) -> list[tuple[int, int, str]]:
    """The edits of the registered query: five characters replaced at a quarter, a word inserted at half,
    and a line appended at the end of the text as it was."""
    n = len(text)
    return [(n // 4, n // 4 + 5, "Edit 42's"), (n // 2, n // 2, " inserted"), (n + 13, n + 13, "\n  One more line.")]


def count_with_edits(
    df: DataFrame,
    vocabulary: bytes,
    pattern: str,
    edits_col: str | None = None,
    text_col: str = "text",
    keep: tuple[str, ...] | None = None,
    trees: bool = False,
    kept_trees: tuple[str, str] | None = None,
) -> DataFrame:
    """Add n_tokens, n_edited_tokens and n_reencoded (pre-tokens encoded anew for the edits).

    ``edits_col`` names a column array<struct<start int, end int, new string>>; without it each
    text gets ``routine_edits``. With ``trees`` the edited text and its tree's leaves are added:
    edited, leaf_chars and leaf_tokens. ``kept_trees`` names two columns such a call has left: rows
    that have leaves there are edited from them, and nothing but the edited regions is encoded;
    rows without are encoded whole. Leaves that aren't the text's raise an error.
    """
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)
    added = [("n_tokens", T.LongType(), pa.int64()), ("n_edited_tokens", T.LongType(), pa.int64()), ("n_reencoded", T.LongType(), pa.int64())]
    if trees:
        ints = (T.ArrayType(T.IntegerType()), pa.list_(pa.int32()))
        added += [("edited", T.StringType(), pa.string()), ("leaf_chars", *ints), ("leaf_tokens", *ints)]
    names = [a[0] for a in added]
    kept = [c for c in (df.columns if keep is None else keep) if c not in names]
    schema = T.StructType([*(df.schema[c] for c in kept), *(T.StructField(n, t) for n, t, _ in added)])

    def one(tree: TokenTree, edits: Iterable) -> tuple:
        before = tree.total
        for start, end, new in edits:
            tree.edit(start, end, new)
        out = (before, tree.total, tree.encoded)
        return (*out, tree.text, *tree.leaves) if trees else out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(shared.value, pattern)
        for batch in batches:
            column = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: B023, E731
            rows = []
            for k in range(batch.num_rows):
                text = column(text_col)[k].as_py() or ""
                given = column(edits_col)[k].as_py() or () if edits_col else None
                edits = routine_edits(text) if given is None else [(e["start"], e["end"], e["new"] or "") for e in given]
                leaves = [column(c)[k].as_py() for c in kept_trees] if kept_trees else [None]
                tree = TokenTree(text, counter) if None in leaves else TokenTree.kept(text, *leaves, counter)
                rows.append(one(tree, edits))
            made = [pa.array([r[i] for r in rows], a[2]) for i, a in enumerate(added)]
            yield pa.RecordBatch.from_arrays([*map(column, kept), *made], names=[*kept, *names])

    return df.select(*dict.fromkeys([*kept, text_col, *([edits_col] if edits_col else []), *(kept_trees or ())])).mapInArrow(run, schema)


def vocabulary(path: str | None = None) -> tuple[bytes, str]:
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return f.read(), public_tokenizers.PATTERN


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_with_edits(docs, *vocabulary(), keep=("doc_id",))


QUERIES = {"op7_token_counts": op7_token_counts}
ORACLES = {}
