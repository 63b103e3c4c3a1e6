"""Language-model scores by prediction by partial matching over bytes.

Training counts every run of ORDER + 1 bytes of the whole training corpus; from these follow the counts of all
shorter runs. They are the nodes of a trie that is kept as rows: a node is a context and the byte after it, a level is the
context's length. Escapes are those of method C; what a longer context has seen is excluded from the shorter ones.
A byte that a context has seen n times of all its T, among K different ones, has probability n / (T + K). Any other has
the context's escape weight, K / (T + K) over the share that the shorter context leaves to bytes not seen here, times its
probability after the shorter context. A byte seen after a context was seen after the shorter ones too, so both numbers
follow from counts of two levels, and Spark works them out level by level. Every run counts, however rare.

Most bytes of a text are found on the longest level. Its commonest runs, 2**SHARE at most, are broadcast as two flat arrays,
and each batch of texts looks its different runs up there. The other runs, one row a text and run, meet the whole trie in
one join by Spark: rare runs, and those of held-out texts that training never met.

The unigram base needs the count of every word of every text. Words with at least 1 / 2**FREQUENT of all
tokens are at most 2**FREQUENT many and are broadcast; the rest are joined by Spark, one row a text and word.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlake.llm.common import crc_bucket, small_batches, stage, utf8
from reviewlake.llm.words import cut

#: A context's bytes at most (five fit the 48 bits of a run's number), and the logarithms of how many runs and words are broadcast.
ORDER, SHARE, FREQUENT = 5, 22, 18
#: Never a byte of UTF-8: ends a text, and stands before it.
END = 0xFF
#: Bytes that are counted or scored at once, and different runs and words that a task sums before it sends them.
BATCH, RUNS, WORDS = 1_000_000, 1_000_000, 150_000


def runs_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The number of the run that ends at each byte of the lower-cased texts and their ends; the bytes of each text with its end."""
    pad = bytes([END]) * ORDER
    size = np.array([len(t) + 1 for t in texts], np.int64)
    raw = b"".join([x for t in texts for x in (pad, t.lower(), b"\xff")]) + bytes(8)
    first = np.cumsum(size + ORDER) - size - ORDER  # where the run of a text's first byte starts
    before = np.cumsum(size) - size
    at = np.repeat(first - before, size) + np.arange(int(size.sum()))
    eight = np.ndarray((len(raw) - 7,), ">u8", raw, 0, (1,))  # the eight bytes from each place on
    return (eight[at] >> np.uint64(64 - 8 * (ORDER + 1))).astype(np.int64), size


def in_batches(texts: list[bytes], most: int) -> Iterator[list[bytes]]:
    """The texts in their order, in lists of about `most` bytes; a longer text is a list of its own."""
    part: list[bytes] = []
    size = 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


def gathered(docs: DataFrame, text_col: str) -> DataFrame:
    """gram or word, n: counts over all of docs. A text adds one to the row with neither. Tasks send sums."""
    names = ["gram", "word", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _last.clear()  # a worker that has scored before holds the model of that time
        words: Counter[bytes] = Counter()
        texts = 0
        kept: list[tuple[np.ndarray, np.ndarray]] = []

        def merge() -> None:
            grams, back = np.unique(np.concatenate([k[0] for k in kept]), return_inverse=True)
            kept[:] = [(grams, np.bincount(back, np.concatenate([k[1] for k in kept]), len(grams)).astype(np.int64))]

        def rows() -> pa.RecordBatch:
            grams, n = kept.pop()
            return pa.RecordBatch.from_arrays([pa.array(grams), pa.nulls(len(grams), pa.binary()), pa.array(n)], names)

        def sums() -> pa.RecordBatch:
            out = [pa.nulls(len(words), pa.int64()), pa.array(list(words), pa.binary()), pa.array(list(words.values()), pa.int64())]
            words.clear()
            return pa.RecordBatch.from_arrays(out, names)

        for b in batches:
            for part in in_batches(b.column(0).to_pylist(), BATCH):
                texts += len(part)
                for t in part:
                    words.update(t.lower().split())
                if len(words) > WORDS:
                    yield sums()
                kept.append(np.unique(runs_of(part)[0], return_counts=True))
                if sum(len(k[0]) for k in kept[1:]) > RUNS:
                    merge()
                    if len(kept[0][0]) > RUNS:
                        yield rows()
        if kept:
            merge()
            yield rows()
        yield sums()
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([texts], pa.int64())], names)

    sent = docs.select(utf8(text_col).alias("t")).mapInArrow(run, "gram long, word binary, n long")
    return sent.groupBy("gram", "word").agg(F.sum("n").alias("n"))


def _low(col: Column | str, count: int) -> Column:
    """The last bytes of a run's number."""
    return (F.col(col) if isinstance(col, str) else col).bitwiseAND(F.lit((1 << 8 * count) - 1))


def trie_levels(counts: DataFrame) -> list[DataFrame]:
    """For each length of context: gram (its bytes and the one after), context, n, total (T + K), escape (the context's weight).

    counts: gram, n of the longest runs. Each level but the longest is staged; the shares of bytes add up to exactly one.
    """
    grams = [counts.select("gram", "n")]
    for k in range(ORDER - 1, -1, -1):
        grams.insert(0, stage(grams[0].groupBy(_low("gram", k + 1).alias("gram")).agg(F.sum("n").alias("n")), "grams"))
    levels: list[DataFrame] = []
    own = Window.partitionBy("context")
    for k, level in enumerate(grams):
        if k:
            shorter = levels[-1].select(F.col("gram").alias("short"), F.col("n").alias("short_n"), F.col("total").alias("short_total"))
            level = level.withColumn("short", _low("gram", k)).join(shorter, "short")
        else:  # before the shortest level all 256 bytes are alike
            level = level.withColumns({"short_n": F.lit(1).cast("long"), "short_total": F.lit(256).cast("long")})
        level = level.withColumn("context", F.shiftright("gram", 8)).withColumns({"kinds": F.count(F.lit(1)).over(own), "held": F.sum("n").over(own), "taken": F.sum("short_n").over(own)})
        total, free = F.col("held") + F.col("kinds"), F.greatest(F.col("short_total") - F.col("taken"), F.lit(1))
        level = level.select("gram", "context", "n", total.alias("total"), (F.col("kinds") / total * F.col("short_total") / free).alias("escape"))
        levels.append(stage(level, "level"))
    return levels


def _key(kind: int, level: int, bits: Column) -> Column:
    return bits + F.lit((kind << 56) + (level << 48))


def trie_table(levels: list[DataFrame]) -> DataFrame:
    """key, value: log10 of the probability of each node, and of the escape weight of each context."""
    parts = []
    for k, level in enumerate(levels):
        parts.append(level.select(_key(0, k, F.col("gram")).alias("key"), F.log10(F.col("n") / F.col("total")).alias("value")))
        parts.append(level.groupBy("context").agg(F.log10(F.min("escape")).alias("value")).select(_key(1, k, F.col("context")).alias("key"), "value"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def gram_scores(asked: DataFrame, table: DataFrame) -> DataFrame:
    """gram, value: log10 probability of the last byte of each asked run. asked: gram, each once."""
    probes = [F.struct(F.lit(k).alias("level"), F.lit(kind).alias("kind"), _key(kind, k, _low("gram", k + 1) if not kind else _low(F.shiftright("gram", 8), k)).alias("key")) for k in range(ORDER + 1) for kind in (0, 1)]
    each = asked.select("gram", F.explode(F.array(*probes)).alias("p")).select("gram", "p.*").join(table, "key")
    met = F.max(F.when(F.col("kind") == 0, F.struct("level", "value"))).alias("met")
    escapes = F.collect_list(F.when(F.col("kind") == 1, F.struct("level", "value"))).alias("escapes")  # one for each level at most
    found = asked.join(each.groupBy("gram").agg(met, escapes), "gram", "left")
    deep, least = F.coalesce("met.level", F.lit(-1)), F.coalesce("met.value", F.lit(float(-np.log10(256))))
    escaped = F.aggregate(F.filter("escapes", lambda e: e["level"] > deep), F.lit(0.0), lambda a, e: a + e["value"])
    return found.select("gram", (least + F.coalesce(escaped, F.lit(0.0))).alias("value"))


_last: dict[str, object] = {}


def _model(sent: Broadcast) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Broadcast runs in order with their logarithms, and hashes of frequent words in order with theirs."""
    _last.update(of=sent.value)
    return _last["of"]


def word_hashes(words: list[bytes]) -> np.ndarray:
    return cut(b"\n" + b"\n".join(words) + b"\n")[2] if words else np.empty(0, np.uint64)


def look_up(keys: np.ndarray, known: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys are known, and their values (0 for others)."""
    if not len(known):
        return np.zeros(len(keys), bool), np.zeros(len(keys))
    spot = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    found = known[spot] == keys
    return found, np.where(found, values[spot], 0.0)


def score_texts(docs: DataFrame, id_col: str, text_col: str, sent: Broadcast) -> DataFrame:
    """row, id, n_tokens, base (sum over frequent words), n_known (of them), score (of broadcast runs), rare (other words
    with their times), runs (numbers of the other runs of bytes with their times)."""
    kind = dict(docs.dtypes)[id_col]
    names = ["row", "id", "n_tokens", "base", "n_known", "score", "rare", "runs"]
    pairs = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))

    def bytes_of(texts: list[bytes]) -> tuple[list[float], np.ndarray, np.ndarray, np.ndarray]:
        """Scores, and how many other runs each text has, which, and how often."""
        known, logs = _model(sent)[:2]
        grams, size = runs_of(texts)
        kinds, code = np.unique(grams, return_inverse=True)
        found, value = look_up(kinds, known, logs)
        score = np.add.reduceat(value[code], np.cumsum(size) - size).tolist()
        odd = np.flatnonzero(~found[code])
        owner = np.searchsorted(np.cumsum(size), odd, side="right")
        both, times = np.unique(owner * np.int64(len(kinds)) + code[odd], return_counts=True)
        return score, np.bincount(both // len(kinds), minlength=len(texts)), kinds[both % len(kinds)], times

    def words_of(texts: list[bytes]) -> list[tuple[int, float, int, list[dict]]]:
        """Tokens, sum over frequent words, how many these are, and the other words of each text."""
        raw = b"\n" + b"\n".join(texts).lower() + b"\n"
        starts, stops, hashes = cut(raw)
        found, value = look_up(hashes, *_model(sent)[2:])
        border = np.searchsorted(starts, np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts]))))
        sums, seen = np.concatenate(([0.0], np.cumsum(value))), np.concatenate(([0], np.cumsum(found)))
        out = []
        for first, last in zip(border[:-1].tolist(), border[1:].tolist(), strict=True):
            known = int(seen[last] - seen[first])
            odd = (np.flatnonzero(~found[first:last]) + first).tolist() if known < last - first else []
            out.append((last - first + 1, float(sums[last] - sums[first]), known, [{"word": w, "n": c} for w, c in Counter(raw[starts[k] : stops[k]] for k in odd).items()]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        for b in batches:
            at = 0
            for some in in_batches(b.column(1).to_pylist(), BATCH):
                score, held, grams, times = bytes_of(some)
                n_tokens, base, known, rare = zip(*words_of(some), strict=True)
                runs = pa.StructArray.from_arrays([pa.array(grams), pa.array(times.astype(np.int32))], ["gram", "n"])
                cols = [
                    pa.array(range(row, row + len(some)), pa.int64()), b.column(0).slice(at, len(some)), pa.array(n_tokens, pa.int64()), pa.array(base, pa.float64()), pa.array(known, pa.int64()),
                    pa.array(score, pa.float64()), pa.array(rare, pairs), pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(held))).astype(np.int32)), runs),
                ]
                row, at = row + len(some), at + len(some)
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = f"row long, id {kind}, n_tokens long, base double, n_known long, score double, rare array<struct<word:binary,n:bigint>>, runs array<struct<gram:bigint,n:int>>"
    return docs.select(id_col, utf8(text_col).alias("t")).mapInArrow(run, schema)


def common_grams(longest: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The commonest runs in order and their logarithms: all of at least some power of two, 2**SHARE runs at most."""
    sizes = longest.groupBy(F.floor(F.log2("n")).alias("power")).count().orderBy(F.desc("power")).collect()  # 63 rows at most
    least, held = None, 0
    for r in sizes:
        held += r["count"]
        if held > 2**SHARE:
            break
        least = 1 << r["power"]
    if least is None:
        return np.empty(0, np.int64), np.empty(0, np.float32)
    rows = longest.where(F.col("n") >= least).select("gram", F.log10(F.col("n") / F.col("total")).cast("float").alias("value")).toArrow()
    grams, logs = np.asarray(rows.column("gram")), np.asarray(rows.column("value"))
    order = np.argsort(grams)
    return grams[order], logs[order]


def common_words(words: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes in order of the words with a share of 1 / 2**FREQUENT, 2**FREQUENT words at most, and logarithms of their counts and one."""
    often = words.where(F.col("n") * 2**FREQUENT >= total).select("word", "n").toArrow()
    hashes, logs = word_hashes(often.column("word").to_pylist()), np.log10(np.asarray(often.column("n")) + 1.0)
    order = np.argsort(hashes)
    return hashes[order], logs[order]


def language_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row.

    Rows whose id's crc32 modulo 7 is 2 are held out of all counts. Null text counts as empty and has its end
    alone. Repeated rows count as often as they stand there; without training rows all bytes are equally
    likely; an empty table gives no rows.
    """
    spark = docs.sparkSession
    with small_batches(spark):
        counts = stage(gathered(docs.where(crc_bucket(id_col, 7) != 2), text_col), "counts")
    words = counts.where(F.col("gram").isNull())
    sums = words.agg(F.sum("n"), F.count_if(F.col("word").isNotNull()), F.sum(F.when(F.col("word").isNull(), F.col("n")))).first()
    total, texts = int(sums[0] or 0), int(sums[2] or 0)
    kinds = int(sums[1] or 0) + (texts > 0)
    words = words.where(F.col("word").isNotNull())
    levels = trie_levels(counts.where(F.col("gram").isNotNull()))
    sent = spark.sparkContext.broadcast((*common_grams(levels[-1]), *common_words(words, total)))
    with small_batches(spark):
        scored = stage(score_texts(docs, id_col, text_col, sent), "scored")
    sent.destroy()  # what follows is Spark's alone

    seldom = words.where(F.col("n") * 2**FREQUENT < total).withColumnRenamed("n", "c")
    rare = scored.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.n")
    nothing, none = F.lit(0.0), F.lit(0).cast("long")
    more = rare.join(seldom, "word").select("row", (F.col("n") * F.log10(F.col("c") + 1.0)).alias("more"), F.col("n").alias("more_known"), nothing.alias("gained"))
    asked = scored.select("row", F.explode("runs").alias("r")).select("row", "r.gram", "r.n")
    values = stage(gram_scores(asked.select("gram").distinct(), trie_table(levels)), "values")
    gained = asked.join(values, "gram").select("row", nothing.alias("more"), none.alias("more_known"), (F.col("n") * F.col("value")).alias("gained"))
    more = more.unionByName(gained).groupBy("row").agg(*[F.sum(c).alias(c) for c in ("more", "more_known", "gained")])
    out = scored.join(more, "row", "left")
    ends = float(np.log10(texts + 1.0))
    base = F.col("base") + F.coalesce("more", nothing) + F.lit(ends) - F.col("n_tokens") * F.lit(float(np.log10(max(1, total + kinds + 1))))
    return out.select(
        F.col("id").alias(id_col), (crc_bucket("id", 7) == 2).alias("held_out"), "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", none) + F.lit(int(texts > 0))).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("score") + F.coalesce("gained", nothing)).alias("score"),
    )
