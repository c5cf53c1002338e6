"""Benchmark decontamination with a broadcast hash set of test n-grams (operator 6), in DataFrame operations only.

Texts are normalised to words; every window of `n` words of a benchmark item (the whole item where it is shorter)
is looked for in the documents. The set of the hashes of all distinct windows is a table of bits, two for each window,
which a scalar subquery makes and sends to the tasks once; its size is BITS_PER_WINDOW bits a window, in whole powers of
two between LEAST_BITS and MOST_BITS (64 MB; a larger benchmark fills the table more, and more windows get past it). A
document's window hashes come by doubling from its words' hashes, so a window costs a few operations whatever `n` is. Only windows whose
bits are set are written out, and the join with the benchmark's windows compares the words themselves: the set decides
nothing, and all benchmarks take this one path. One row per document reaches the only shuffle besides the hit windows, and
no text does.

Defined results: null texts and texts of separators have no words, no hits and are clean; repeated rows are judged
each; items that share a window are all reported (the list of a window's items is as long as the benchmark repeats it);
an empty benchmark leaves everything clean; a null item_id is reported as an empty string; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isobarn.llm.common import TAG, materialize, tagged

N = 13
#: A document is contaminated if one in so many of its words is hit.
ONE_IN = 20
#: Size of the hash set: bits for each window, and the powers of two within which it is kept.
BITS_PER_WINDOW = 32
LEAST_BITS, MOST_BITS = 20, 29
#: Bytes of benchmark windows up to which the verifying join broadcasts them.
MOST_BROADCAST = 64 << 20
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words after lower-casing A-Z; none for null."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    plain = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(plain, BREAK, -1), "")


def hashes_sql(words_: str, length: int) -> str:
    """SQL: a hash of each window of `length` words, by doubling; the last places, where no window starts, have others."""
    out, size = f"transform({words_}, w -> xxhash64(w))", 1
    while size < length:
        step = min(size, length - size)  # the last step overlaps
        out = f"transform(array({out}), h -> transform(h, (x, i) -> xxhash64(x, get(h, i + {step}))))[0]"
        size += step
    return out


def benchmark_windows(benchmark: DataFrame, n: int = N) -> DataFrame:
    """gram, len, hash, items (as strings): the distinct windows of all items."""
    bound = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("ws"))
    each = (
        bound.where(F.size("ws") > 0)
        .withColumn("len", F.least(F.size("ws"), F.lit(n)))
        .select("item", "ws", "len", F.explode(F.sequence(F.lit(1), F.size("ws") - F.col("len") + 1)).alias("i"))
        .select("item", "len", F.slice("ws", F.col("i"), F.col("len")).alias("ws"))
    )
    cases = " ".join(f"WHEN len = {k} THEN {hashes_sql('ws', k)}[0]" for k in range(1, n + 1))
    found = each.select("item", "len", F.array_join("ws", " ").alias("gram"), F.expr(f"CASE {cases} END").alias("hash"))
    return found.groupBy("gram", "len", "hash").agg(F.sort_array(F.collect_set("item")).alias("items"))


def _places(x: str, bits: int) -> list[str]:
    """SQL of the two places of a hash in a table of 2^bits bits: its low and its high bits."""
    return [f"({x} & {(1 << bits) - 1}L)", f"shiftrightunsigned({x}, {64 - bits})"]


def hash_set(windows: DataFrame, bits: int) -> DataFrame:
    """One row: an array of 2^bits bits in 64-bit numbers, the bits of all hashes set."""
    places = windows.select(F.explode(F.array(*map(F.expr, _places("hash", bits)))).alias("p"))
    held = places.groupBy(F.expr("p div 64").alias("id")).agg(F.bit_or(F.expr("shiftleft(1L, int(p % 64))")).alias("b"))
    every = windows.sparkSession.range(1 << bits - 6).join(held, "id", "left")
    return every.agg(F.transform(F.sort_array(F.collect_list(F.struct("id", F.coalesce("b", F.lit(0).cast("bigint")).alias("b")))), lambda x: x["b"]).alias("bits"))  # 2^bits bits


def _scan(lengths: list[int], bits: int) -> str:
    """SQL of struct (n_words, hits array of pos, len, gram) over a struct z of words ws and the hash set."""
    kind = "array<struct<pos:int,len:int,gram:string>>"
    parts = [f"cast(array() AS {kind})"]
    for length in lengths:
        there = " AND ".join(f"getbit(z.bits[int({p} div 64)], int({p} % 64)) = 1" for p in _places("h[i]", bits))
        places = f"transform(array({hashes_sql('z.ws', length)}), h -> filter(sequence(0, size(z.ws) - {length}), i -> {there}))[0]"
        hits = f"transform({places}, i -> struct(i AS pos, {length} AS len, array_join(slice(z.ws, i + 1, {length}), ' ') AS gram))"
        parts.append(f"if(size(z.ws) >= {length}, cast({hits} AS {kind}), cast(array() AS {kind}))")
    return f"struct(size(z.ws) AS n_words, flatten(array({', '.join(parts)})) AS hits)"


def contamination(documents: DataFrame, benchmark: DataFrame, n: int = N, one_in: int = ONE_IN) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items, contaminated of every row.

    A document is contaminated if the words inside occurring windows are at least one in `one_in` of its words.
    """
    windows = materialize(benchmark_windows(benchmark, n), "windows")
    sizes = windows.groupBy("len").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("gram") + F.size("items") * 40).alias("bytes")).collect()  # <= n rows
    total = sum(r["n"] for r in sizes)
    bits = min(max(LEAST_BITS, (BITS_PER_WINDOW * total).bit_length()), MOST_BITS)
    # the words are bound once by the outer transform; the row number keeps the optimizer from repeating the scan
    one = documents.select("doc_id", F.array(F.struct(words(F.col("text")).alias("ws"), hash_set(windows, bits).scalar().alias("bits"))).alias("one"))
    scanned = one.select("doc_id", F.expr(f"transform(one, z -> {_scan(sorted(r['len'] for r in sizes), bits)})[0]").alias("scan"), F.monotonically_increasing_id().alias("row"))
    flat = scanned.select("doc_id", "row", "scan.n_words", "scan.hits")
    hits = flat.select("doc_id", "row", "n_words", F.explode_outer("hits").alias("hit"))
    key = F.coalesce(F.col("hit.gram"), F.concat(F.lit(" "), F.col("row").cast("string")))
    hits = hits.select("doc_id", "row", "n_words", "hit.pos", "hit.len", key.alias("gram"))
    items = windows.select("gram", "items")
    small = sum(r["bytes"] for r in sizes) <= MOST_BROADCAST
    found = hits.join(F.broadcast(items) if small else items, "gram", "left")
    covered = F.when(F.col("items").isNotNull(), F.struct("pos", (F.col("pos") + F.col("len")).alias("stop")))
    by_row = found.groupBy("row", "doc_id", "n_words").agg(F.collect_set(covered).alias("c"), F.collect_list("items").alias("i"))
    # covered words: what each window adds to those before it
    n_hit = "aggregate(array_sort(c), struct(0 AS reach, 0L AS n), (a, x) -> struct(greatest(a.reach, x.stop) AS reach, a.n + greatest(0, x.stop - greatest(a.reach, x.pos)) AS n), a -> a.n)"
    names = F.sort_array(F.array_distinct(F.flatten("i")))
    out = by_row.select("doc_id", F.col("n_words").cast("bigint").alias("n_words"), F.expr(n_hit).alias("n_hit"), names.alias("items"))
    bad = (F.col("n_hit") > 0) & (F.lit(one_in) * F.col("n_hit") >= F.col("n_words"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), "items", bad.alias("contaminated"))


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, n: int = N, one_in: int = ONE_IN) -> DataFrame:
    """The documents that are not contaminated. Rows are judged each, whatever their doc_id."""
    rows = tagged(documents)
    found = contamination(rows.select(F.col(TAG).alias("doc_id"), "text"), benchmark, n, one_in)
    bad = found.where("contaminated").select(F.col("doc_id").alias(TAG))
    return rows.join(bad, TAG, "left_anti").select(*documents.columns)
