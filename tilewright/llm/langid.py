"""Language by cross-parsing entropy: suffix automata of labelled text, longest matches, fewest normalised phrases.

For each language the automaton of a sample of labelled text knows all its substrings. A text is parsed from left to right into
phrases, each the longest match with something in the sample; a symbol that the sample lacks is a phrase of its own. Naming a
place in a sample of n symbols takes log2(n) bits, so phrases * log2(n) / symbols is the text's cross entropy under that language;
the language with the least wins. Languages with the same least cost go by the number of their training documents, then by name.

Symbols are lower-case letters; each run of other characters is one gap. The parse follows one transition a symbol: where an automaton has none,
a new phrase begins at its root. With these restarts written into its table an automaton becomes one array, and all texts of a
batch advance by one symbol at a time in all languages at once. A text is parsed in slices of SLICE characters and pieces of PIECE symbols,
whose edges end a phrase in every language alike; so long texts take part whole without being followed alone.

The sample is bounded, all else isn't: of each language (MAX_LANGS at most) SAMPLE_ROWS training rows with the least hashes are read, equal texts
once, and whole texts are taken in this order until SYMBOLS is reached; texts longer than that are left out of the sample.
Tables of all languages take MODEL_BYTES at most: many languages or letters make shorter samples.

Defined results: null, empty and letterless texts are `und` with score 0, as is everything where nothing can be learned. Equal texts get equal
results. Rows with a null id or language are scored like any other; a null language is never learned. Other columns are carried
along, except those named lang_pred and score, which are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from . import common

SYMBOLS = 48_000  # of a language's sample
SAMPLE_ROWS = 300  # of a language that are read for it
MAX_LANGS = 4096  # that are learned, those with most rows
MAX_CLASSES = 256  # symbols that are told apart
MODEL_BYTES = 256 << 20
SLICE, PIECE = 1 << 20, 1024
UND = "und"


@dataclass
class Model:
    """Automata of all languages in one table: go[base + symbol] is the next state's base, doubled, plus 1 where a phrase begins."""

    langs: list[str]
    classes: dict[str, int]  # letters that have a symbol; others share symbol 1, gaps are 0
    go: np.ndarray
    roots: np.ndarray  # the base of each language's root
    bits: np.ndarray  # log2 of each sample's length


def symbols(text: str, classes: dict[str, int]) -> list[int]:
    """The symbols of one text, as the docstring says."""
    out: list[int] = []
    for c in text.lower():
        s = classes.get(c, 1) if c.isalpha() else 0
        if s or not out or out[-1]:
            out.append(s)
    return out


def automaton(sample: Sequence[int], width: int) -> list[list[int]]:
    """Transitions of the suffix automaton of a sequence, 0 (the root, to which none leads) where there is none."""
    step, link, length, last = [[0] * width], [-1], [0], 0
    for c in sample:
        new = len(step)
        step.append([0] * width)
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and not step[p][c]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                clone = len(step)
                step.append(step[q][:])
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p][c] == q:
                    step[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    return step


def build(texts: dict[str, list[str]]) -> Model:
    """texts: each language's sample, the language with most training documents first."""
    found = Counter(c for ts in texts.values() for t in ts for c in t.lower() if c.isalpha())
    classes = {c: k + 2 for k, (c, _) in enumerate(sorted(found.items(), key=lambda x: (-x[1], x[0]))[: MAX_CLASSES - 2])}
    width, langs, tables, roots, bits, at = len(classes) + 2, [], [], [], [], 0
    most = min(SYMBOLS, MODEL_BYTES // (8 * width * max(1, len(texts))))
    for lang, ts in texts.items():
        sample: list[int] = []
        for t in ts:
            if len(more := [*symbols(t, classes), 0]) + len(sample) <= most + 1:
                sample += more
        if not any(sample):
            continue
        step = np.array(automaton(sample, width), np.int64)
        begun = (at + step[0] * width) * 2 + 1
        table = np.where(step > 0, (at + step * width) * 2, begun)
        table[0] = begun
        langs.append(lang)
        tables.append(table.ravel().astype(np.int32))
        roots.append(at)
        bits.append(np.log2(max(2, len(sample))))
        at += step.size
    return Model(langs, classes, np.concatenate([np.zeros(0, np.int32), *tables]), np.array(roots, np.int64), np.array(bits))


@cache
def _letters() -> np.ndarray:
    """1 for each code point that is a letter."""
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), np.uint8)


class Parser:
    def __init__(self, model: Model):
        self.model = model
        self.symbol = _letters().astype(np.uint8 if len(model.classes) < 254 else np.int16)
        for c, k in model.classes.items():
            self.symbol[ord(c)] = k

    def phrases(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text its phrases in each language, its symbols and its letters."""
        slices = [(i, t[k : k + SLICE].lower()) for i, t in enumerate(texts) for k in range(0, len(t), SLICE)]
        n = len(texts)
        if not slices:
            return np.zeros((n, len(self.model.langs)), np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        of = np.array([i for i, _ in slices])
        starts = np.cumsum([0, *(len(t) for _, t in slices)])
        found = self.symbol[np.frombuffer("".join(t for _, t in slices).encode("utf-32-le", "surrogatepass"), np.uint32)]
        letter = found > 0
        letters = np.bincount(of, np.add.reduceat(letter, starts[:-1], dtype=np.int64), n).astype(np.int64)
        kept = letter.copy()
        kept[1:] |= letter[:-1]  # the first character of a gap
        kept[starts[:-1]] = True
        sizes = np.add.reduceat(kept, starts[:-1], dtype=np.int64)
        stream = found[kept]
        begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        parts = -(-sizes // PIECE)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        at = np.repeat(begin, parts) + nth * PIECE
        long = np.minimum(np.repeat(sizes, parts) - nth * PIECE, PIECE)
        order = np.argsort(-long, kind="stable")
        counts = self._walk(stream, at[order], long[order])
        owner = np.repeat(of, parts)[order]
        per = np.stack([np.bincount(owner, c, n) for c in counts], 1) if len(counts) else np.zeros((n, 0))
        return per.astype(np.int64), np.bincount(of, sizes, n).astype(np.int64), letters

    def _walk(self, stream: np.ndarray, at: np.ndarray, long: np.ndarray) -> np.ndarray:
        """Phrases of each piece in each language. at, long: where the pieces begin and their lengths, the longest first."""
        langs, n = len(self.model.roots), len(at)
        base = np.repeat(self.model.roots[:, None], n, 1)
        count = np.zeros((langs, n), np.int32)
        live = n - np.searchsorted(long[::-1], np.arange(1, long[0] + 1))  # pieces that have a symbol at each step
        for k in range(len(live)):
            m = live[k]
            v = np.take(self.model.go, base[:, :m] + stream[at[:m] + k])
            count[:, :m] += v & 1
            np.right_shift(v, 1, out=base[:, :m], casting="unsafe")
        return count

    def best(self, texts: Sequence[str]) -> tuple[list[str], np.ndarray]:
        """Language and confidence of each text: its share of 2 to the power of minus each language's bits."""
        per, size, letters = self.phrases(texts)
        if not self.model.langs:
            return [UND] * len(texts), np.zeros(len(texts))
        bits = per * self.model.bits
        first = bits.argmin(1)
        share = 1 / np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000)).sum(1)
        known = letters > 0
        return [self.model.langs[k] if x else UND for k, x in zip(first.tolist(), known.tolist(), strict=True)], np.where(known, share, 0.0)


def sample(docs: DataFrame) -> dict[str, list[str]]:
    """Of each language the texts to learn from; docs: (doc_id, text, lang). Rows are counted first, and then only those whose hash lies
    below the share that about twice SAMPLE_ROWS rows of their language have leave their task, however many tasks there are."""
    learned = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~common.held_out(F.col("doc_id")))
    found = learned.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "lang").limit(MAX_LANGS).collect()
    shares = docs.sparkSession.createDataFrame([(r.lang, min(1.0, 2 * SAMPLE_ROWS / r.n) * 2.0**63) for r in found], "lang string, _below double")
    by = W.partitionBy("lang").orderBy("_h", "doc_id", "text")
    rows = learned.filter(F.char_length("text") <= SYMBOLS).withColumn("_h", F.shiftrightunsigned(F.xxhash64("doc_id", "text", F.lit(12)), 1))
    rows = rows.join(F.broadcast(shares), "lang").filter(F.col("_h") < F.col("_below"))  # a row for each language, MAX_LANGS at most
    rows = rows.select("lang", "text", "doc_id", "_h").withColumn("_k", F.row_number().over(by)).filter(F.col("_k") <= SAMPLE_ROWS)
    total = F.sum(F.char_length("text")).over(by.rowsBetween(W.unboundedPreceding, W.currentRow))
    some = rows.withColumn("_total", total).filter(F.col("_total") <= 4 * SYMBOLS)
    texts: dict[str, dict[str, None]] = {r.lang: {} for r in found}
    for r in some.orderBy("lang", "_k").toLocalIterator():
        texts[r.lang][r.text] = None
    return {lang: list(ts) for lang, ts in texts.items() if ts}


def train(docs: DataFrame) -> Model:
    """docs: (doc_id, text, lang, ...); ids alone decide what is held out."""
    return build(sample(docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))))


def predict(df: DataFrame, model: Model, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """The columns in keep (all but those replaced) with lang_pred and score; one Arrow pass without a shuffle. The model's size
    doesn't depend on the data."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in (df.columns if keep is None else keep) if c not in ("lang_pred", "score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser(shared.value)
        for b in common.chunks(batches, "text"):
            langs, score = parser.best([t or "" for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(score, pa.float64())], names=["row", "lang_pred", "score"])

    # other columns travel in one, so that none can clash
    row = F.struct(*(F.col(f"`{c}`") for c in keep)) if keep else F.struct(F.lit(0).alias("_"))
    packed = df.select(row.alias("row"), F.col(f"`{text}`").cast("string").alias("text"))
    out = packed.mapInArrow(run, T.StructType([packed.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
    return out.select(*(["row.*"] if keep else []), "lang_pred", "score")


def op12_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = predict(docs, train(docs), keep=["doc_id"])
    return out.select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


QUERIES = {"op12_cross_parsing": op12_cross_parsing}
SQL: dict[str, str] = {}
