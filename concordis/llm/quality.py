"""Quality classifier: an interpolated modified Kneser-Ney model of characters, trained on trusted text.

Symbols are the code points of a text, none folded, so the model grows with the text it is trained on.  An n-gram is
its code points in three bytes each.

Training: each task counts the n-grams of its share of the trusted texts, counts are added up by
n-gram shard, and each order is joined with its contexts' totals (both sharded by context) to give the discounted
share of every n-gram and the weight each context leaves to the shorter order.  Lower orders count different
left neighbours.  Discounts D1, D2, D3+ come from the numbers of n-grams seen once to four times.  These tables stay
sharded; nothing of the model passes through the driver but the discounts.

Scoring: documents are dealt into slices of about ``SLICE_CHARS`` characters.  Tasks list the different n-grams of
each slice; all different n-grams are joined with shares and weights, order by order, and each slice gets the
probabilities of its own n-grams back, next to its texts, where they are summed by document.

Trusted texts are the labelled documents of good quality that are not toxic.  A hash of the id puts one in
``HOLD_OUT`` aside: those do not train the model but set the thresholds.  Each language's threshold is the
``KEEP`` quantile of its held-out texts' log perplexity (by histogram with bins of ``BIN``), plus ``MARGIN``.  To each
language's texts ``PRIOR`` more are added that are spread as those of all languages, by one formula for any number of
texts: few texts lean on all languages, many speak for themselves, and a language without any has the quantile over all.

A document is kept if its log perplexity (nats per symbol) is at most the threshold.

Cases: null and empty texts hold no symbols; their perplexity is null and they are rejected.  A null
language has its own threshold.  Without trusted text no model can be trained, and every text with symbols is kept.  Repeated
rows are scored alike.  Repeated or contradicting labels of one id count as trusted only if all agree.
Other columns are kept by ``kept_documents`` only as far as they are columns of documents.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordis.llm.common import DOCUMENT_COLUMNS, saved, slices, table, whole

ORDER = 4
SYMBOLS = 48
HOLD_OUT = 5
KEEP = 0.995
BIN = 0.002
MARGIN = 0.05
PRIOR = 50
CHUNK = 1 << 20
#: Code points there are; characters of a slice of documents.
POINTS = 0x110000
SLICE_CHARS = 1 << 24

#: Folded classes, for the small model that the tests hold against plain code.
#: Fixed symbols besides a-z (1 to 26) and other letters (27 to 34): white space, line end, digit, marks.
SPACE, LINE, DIGIT, UPPER_RUN, STOP, COMMA, QUOTE, OTHER = 0, 35, 36, 37, 38, 39, 40, 41
MARKS = {".": STOP, "!": STOP, "?": STOP, ",": COMMA, ";": COMMA, ":": COMMA, "'": QUOTE, '"': QUOTE, "-": QUOTE,
         "#": 42, "%": 43, "$": 44, "&": 45, "*": 46, "|": 47}


def symbol_table() -> np.ndarray:
    """The symbol of every code point: a folded letter, or what kind of mark it is."""
    symbols = np.full(0x110000, OTHER, dtype=np.uint8)
    for code in range(0x3000):
        char = chr(code)
        base = unicodedata.normalize("NFD", char)[0].lower()
        if char == "\n":
            symbols[code] = LINE
        elif char.isspace():
            symbols[code] = SPACE
        elif char.isdigit():
            symbols[code] = DIGIT
        elif char in MARKS:
            symbols[code] = MARKS[char]
        elif "a" <= base[0] <= "z" and char.isascii():
            symbols[code] = ord(base[0]) - 96
        elif char.isalpha():
            symbols[code] = 27 + code % 8
    # Letters of scripts further up (CJK, Hangul and so on).
    for low, high in ((0x3000, 0xD800), (0xF900, 0xFB00), (0x20000, 0x32000)):
        symbols[low:high] = 27 + np.arange(low, high) % 8
    return symbols


def _symbols(text: str, symbols: np.ndarray) -> np.ndarray:
    """Symbols of a text; a capital after a capital is marked, so that shouting differs from prose."""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4")
    found = symbols[codes]
    upper = (codes >= 65) & (codes <= 90)
    found[1:][upper[1:] & upper[:-1]] = UPPER_RUN
    return found


def gram_codes(texts: list[str], symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all n-grams that end at a symbol of a text, and how many each text has.

    Every text is preceded by spaces, so its first symbols have a full context.
    """
    parts = [_symbols(t, symbols) for t in texts]
    pad = np.zeros(ORDER - 1, dtype=np.uint8)
    line = np.concatenate([x for p in parts for x in (pad, p)] or [pad]).astype(np.int32)
    codes = line.copy()
    for back in range(1, ORDER):
        codes[back:] += line[:-back] * SYMBOLS**back
    lengths = np.array([len(p) for p in parts], dtype=np.int64)
    own = np.ones(len(line), dtype=bool)
    for i, end in enumerate(np.cumsum(lengths + ORDER - 1)):
        own[end - lengths[i] - ORDER + 1 : end - lengths[i]] = False
    return codes[own[: len(codes)]] if len(parts) else codes[:0], lengths


def _chunks(batch, size: int = CHUNK):
    """Groups of rows with about ``size`` characters, so that arrays stay small; a longer text stands alone."""
    texts = [t or "" for t in batch.column("text").to_pylist()]
    start, held = 0, 0
    for i, text in enumerate(texts):
        if held and held + len(text) > size:
            yield start, texts[start:i]
            start, held = i, 0
        held += len(text)
    if start < len(texts):
        yield start, texts[start:]


def trusted_ids(labels: DataFrame) -> DataFrame:
    good = (F.coalesce("quality", F.lit(0)) == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    return (
        labels.where(F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.bool_and(good).alias("trusted"))
        .where("trusted")
        .select("doc_id", (F.pmod(F.xxhash64("doc_id"), F.lit(HOLD_OUT)) == 0).alias("held_out"))
    )


def count_grams(texts: DataFrame) -> DataFrame:
    """gram, n: counts of the highest order over all rows of ``texts``."""

    def run(batches):
        symbols, counts = symbol_table(), np.zeros(SYMBOLS**ORDER, dtype=np.int64)
        for batch in slices(batches):
            for _, part in _chunks(batch):
                np.add.at(counts, gram_codes(part, symbols)[0], 1)
        grams = np.flatnonzero(counts)
        for at in range(0, len(grams), 50_000):
            part = grams[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(counts[part], pa.int64())], ["gram", "n"])

    return texts.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


class Model:
    """The interpolated steps, shortest order first: discounted shares by n-gram and weights left by context."""

    def __init__(self, orders: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]):
        self.orders = orders

    def log_probabilities(self) -> np.ndarray:
        probabilities = np.full(SYMBOLS, 1.0 / SYMBOLS, dtype=np.float32)
        for order, (grams, shares, contexts, left) in enumerate(self.orders, start=1):
            # A context that was never seen leaves everything to the shorter one.
            weights = np.ones(SYMBOLS ** (order - 1), dtype=np.float32)
            weights[contexts] = left
            # Rows are contexts; those that differ in their first symbol share the shorter contexts.
            shorter = probabilities.reshape(-1, SYMBOLS)
            longer = weights.reshape(-1, len(shorter), 1) * shorter
            probabilities = longer.reshape(-1)
            probabilities[grams] += shares.astype(np.float32)
        return np.log(probabilities, out=probabilities)


def discounts(counts: DataFrame) -> list[float]:
    """Modified Kneser-Ney discounts of n-grams seen once, twice, and three times or more."""
    row = counts.agg(*[F.count_if(F.col("n") == k).alias(f"n{k}") for k in (1, 2, 3, 4)]).first()
    seen = [max(1, row[f"n{k}"]) for k in (1, 2, 3, 4)]
    base = seen[0] / (seen[0] + 2 * seen[1])
    return [min(max(k - (k + 1) * base * seen[k] / seen[k - 1], 0.05), k - 0.05) for k in (1, 2, 3)]


def steps(counts: DataFrame, context, shorter):
    """From the highest order down: (gram, share) and (context, left); ``context`` and ``shorter`` give columns for an order."""
    for order in range(ORDER, 0, -1):
        d1, d2, d3 = discounts(counts)
        discount = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        placed = counts.withColumns({"context": context(order), "cut": discount})
        totals = placed.groupBy("context").agg(F.sum("n").alias("total"), F.sum("cut").alias("cut_total"))
        shares = placed.join(totals, "context").select("gram", ((F.col("n") - F.col("cut")) / F.col("total")).alias("share"))
        yield shares, totals.select("context", (F.col("cut_total") / F.col("total")).alias("left"))
        # The next shorter order counts in how many contexts, that is after how many symbols, an n-gram was seen.
        if order > 1:
            counts = saved(counts.groupBy(shorter(order).alias("gram")).agg(F.count(F.lit(1)).alias("n")), "grams")


def train(texts: DataFrame) -> Model | None:
    """The model over the folded classes, gathered: small enough to be held against plain code."""
    counts = saved(count_grams(texts), "grams")
    if counts.isEmpty():
        return None
    orders = []
    context = lambda order: F.floor(F.col("gram") / SYMBOLS).cast("long")
    for shares, left in steps(counts, context, lambda order: F.pmod("gram", F.lit(SYMBOLS ** (order - 1)))):
        shares, left = shares.toPandas(), left.toPandas()
        orders.append((shares["gram"].to_numpy(), shares["share"].to_numpy(), left["context"].to_numpy(), left["left"].to_numpy()))
    return Model(orders[::-1])


def point_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different n-grams of code points (bytes), the number of the one that ends at each character, and the texts' lengths."""
    pad = " " * (ORDER - 1)
    codes = np.frombuffer("".join(pad + t for t in texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    first = np.cumsum(lengths + ORDER - 1) - lengths - ORDER + 1  # where each window of a text's first character starts
    starts = np.arange(lengths.sum()) + np.repeat(first - (np.cumsum(lengths) - lengths), lengths)
    present = np.zeros(POINTS, dtype=bool)
    present[codes] = True
    points = np.flatnonzero(present)
    numbers = np.zeros(POINTS, dtype=np.int64)
    numbers[points] = np.arange(len(points))
    base, small = len(points), numbers[codes]
    if base**ORDER < 1 << 63:
        keys = np.zeros(len(starts), dtype=np.int64)
        for i in range(ORDER):
            keys = keys * base + small[starts + i]
        grams, inverse = np.unique(keys, return_inverse=True)
        columns = [points[grams // base ** (ORDER - 1 - i) % base] for i in range(ORDER)]
    else:
        grams, inverse = np.unique(np.stack([codes[starts + i] for i in range(ORDER)], axis=1), axis=0, return_inverse=True)
        columns = list(grams.T)
    wide = np.empty((len(grams), ORDER, 3), dtype=np.uint8)
    for i, column in enumerate(columns):
        for byte in range(3):
            wide[:, i, byte] = column >> (16 - 8 * byte) & 255
    return wide.reshape(-1).view(f"S{3 * ORDER}"), inverse.reshape(-1), lengths


def _binary(grams: np.ndarray) -> pa.Array:
    """Fixed-width bytes as an Arrow column; closing zero bytes belong to them."""
    width = grams.dtype.itemsize
    offsets = np.arange(0, width * len(grams) + 1, width, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(grams), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(grams))])


def count_points(texts: DataFrame) -> DataFrame:
    """gram, n: counts of the highest order over code points, over all rows of ``texts``."""

    def run(batches):
        for batch in batches:
            for _, part in _chunks(batch):
                grams, inverse, _ = point_grams(part)
                counts = np.bincount(inverse, minlength=len(grams))
                for at in range(0, len(grams), 50_000):
                    yield pa.RecordBatch.from_arrays(
                        [_binary(grams[at : at + 50_000]), pa.array(counts[at : at + 50_000], pa.int64())], ["gram", "n"]
                    )

    return texts.select("text").mapInArrow(run, "gram binary, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _context(order: int):
    return F.substring("gram", 1, 3 * (order - 1))


def _shorter(order: int):
    return F.substring("gram", 4, 3 * (order - 1))


def train_points(texts: DataFrame) -> list[tuple[DataFrame, DataFrame]] | None:
    """Shares and weights of each order, shortest first, as stored tables."""
    counts = saved(count_points(texts), "grams")
    if counts.isEmpty():
        return None
    return [(saved(shares, "shares"), saved(left, "left")) for shares, left in steps(counts, _context, _shorter)][::-1]


def log_probabilities(grams: DataFrame, model: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """gram, log_p of different n-grams of the highest order."""
    wanted = [grams]
    for order in range(ORDER, 1, -1):
        wanted.append(wanted[-1].select(_shorter(order).alias("gram")).distinct())
    known = None
    for order, (shares, left) in enumerate(model, start=1):
        rows = wanted[ORDER - order].withColumns({"context": _context(order), "shorter": _shorter(order)})
        rows = rows.join(shares, "gram", "left").join(left, "context", "left")
        if known is None:
            rows = rows.withColumn("shorter_p", F.lit(1.0 / POINTS))
        else:
            rows = rows.join(known.select(F.col("gram").alias("shorter"), F.col("p").alias("shorter_p")), "shorter")
        # A context that was never seen leaves everything to the shorter one.
        p = F.coalesce("share", F.lit(0.0)) + F.coalesce("left", F.lit(1.0)) * F.col("shorter_p")
        known = rows.select("gram", p.alias("p"))
    return known.select("gram", F.log("p").alias("log_p"))


def _scored(docs: DataFrame, model: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """doc_id, lang, text_hash and log perplexity of every row."""
    total = docs.agg(F.sum(F.char_length("text"))).first()[0] or 0
    text_hash = F.xxhash64("text")
    sliced = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "lang", "text", text_hash.alias("text_hash"),
        F.pmod(F.xxhash64("doc_id", text_hash), F.lit(1 + total // SLICE_CHARS)).alias("slice"),
    )

    def listed(batches):
        held, size = {}, 0

        def rows():
            for number, texts in held.items():
                grams = point_grams(texts)[0]
                for at in range(0, len(grams), 50_000):
                    part = grams[at : at + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), number), pa.int64()), _binary(part)], ["slice", "gram"])

        for batch in batches:
            for number, text in zip(batch.column("slice").to_pylist(), batch.column("text")):
                text = text.as_py() or ""
                held.setdefault(number, []).append(text)
                size += len(text)
                if size >= SLICE_CHARS:
                    yield from rows()
                    held, size = {}, 0
        yield from rows()

    wanted = saved(sliced.select("slice", "text").mapInArrow(listed, "slice long, gram binary").distinct(), "wanted")
    known = saved(log_probabilities(wanted.select("gram").distinct(), model), "known")
    own = wanted.join(known, "gram")

    def summed(texts: pa.Table, table: pa.Table) -> pa.Table:
        grams = np.frombuffer(b"".join(table.column("gram").to_pylist()), dtype=f"S{3 * ORDER}")
        order = np.argsort(grams)
        grams, logs = grams[order], table.column("log_p").to_numpy()[order]
        scores = np.full(texts.num_rows, np.nan)
        for start, part in _chunks(texts):
            found, inverse, lengths = point_grams(part)
            if not len(found):
                continue
            values = logs[np.searchsorted(grams, found)][inverse]
            ends = np.cumsum(lengths)
            sums = np.concatenate(([0.0], np.cumsum(values)))
            with np.errstate(invalid="ignore", divide="ignore"):
                scores[start : start + len(part)] = -(sums[ends] - sums[ends - lengths]) / lengths
        column = pa.array(scores, pa.float64(), from_pandas=True)
        return texts.select(["doc_id", "lang", "text_hash"]).append_column("log_perplexity", column)

    scores = sliced.groupBy("slice").cogroup(own.groupBy("slice")).applyInArrow(
        summed, "doc_id long, lang string, text_hash long, log_perplexity double"
    )
    return saved(scores, "scores")


def thresholds(scores: DataFrame, keep: float = KEEP, margin: float = MARGIN, prior: float = PRIOR) -> tuple[DataFrame, float]:
    """(lang, threshold) of the languages with held-out texts, and the threshold of any other language."""
    bins = scores.where(F.col("log_perplexity").isNotNull()).select("lang", F.ceil(F.col("log_perplexity") / BIN).alias("bin"))
    counted = saved(bins.groupBy("lang", "bin").count(), "bins")
    # Log perplexity is at most the log of the least probability, so the number of bins is bounded.
    overall = counted.groupBy("bin").agg(F.sum("count").alias("count")).orderBy("bin").collect()
    every = np.array([r["bin"] for r in overall], dtype=np.int64)
    share = np.array([r["count"] for r in overall], dtype=float)
    share = share / share.sum() if len(share) else share

    def quantile(weights: np.ndarray) -> float:
        reached = np.cumsum(weights) >= keep * weights.sum() * (1 - 1e-12)
        return float(every[reached][0] * BIN + margin)

    def blended(rows: pd.DataFrame) -> pd.DataFrame:
        weights = prior * share
        weights[np.searchsorted(every, rows["bin"])] += rows["count"]
        return pd.DataFrame({"lang": [rows["lang"].iloc[0]], "threshold": [quantile(weights)]})

    by_language = counted.groupBy("lang").applyInPandas(blended, "lang string, threshold double")
    return by_language, quantile(share) if len(share) else float("inf")


def fit(docs: DataFrame, labels: DataFrame) -> list[tuple[DataFrame, DataFrame]] | None:
    """A model of the trusted documents that were not set aside."""
    known = trusted_ids(labels).where(~F.col("held_out")).select("doc_id")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # Labels grow with the documents: the join is the same at every size.
    return train_points(rows.join(known.hint("merge"), "doc_id", "left_semi"))


def _judged(scores: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores with their language's threshold, from the trusted documents set aside, and ``kept``."""
    known = trusted_ids(labels).where("held_out").select("doc_id")
    by_language, elsewhere = thresholds(scores.join(known, "doc_id", "left_semi"))
    own = saved(by_language, "thresholds").withColumnsRenamed({"lang": "known_lang", "threshold": "own"})
    return (
        scores.join(own, F.col("lang").eqNullSafe(F.col("known_lang")), "left")
        .withColumn("threshold", F.coalesce("own", F.lit(elsewhere)))
        .withColumn("kept", F.coalesce(F.col("log_perplexity") <= F.col("threshold"), F.lit(False)))
    )


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, log_perplexity, threshold, kept for every row."""
    model = fit(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")
    if model is None:
        none = F.lit(None).cast("double")
        return rows.select(
            "doc_id", "lang", none.alias("log_perplexity"), none.alias("threshold"),
            (F.length(whole(F.col("text"))) > 0).alias("kept"),
        )
    return _judged(_scored(rows, model), labels).select("doc_id", "lang", "log_perplexity", "threshold", "kept")


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that stay, with the columns of documents."""
    model = fit(docs, labels)
    rows = docs.select(*DOCUMENT_COLUMNS)
    if model is None:
        return rows.where(F.length("text") > 0)
    left_out = _judged(_scored(docs, model), labels).where(~F.col("kept")).select(
        F.col("doc_id").alias("out_id"), F.col("lang").alias("out_lang"), F.col("text_hash").alias("out_hash")
    ).distinct()
    same = (
        F.col("doc_id").cast("long").eqNullSafe(F.col("out_id")) & F.col("lang").eqNullSafe(F.col("out_lang"))
        & (F.xxhash64("text") == F.col("out_hash"))
    )
    return rows.join(left_out, same, "left_anti")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
