"""Exact medians of many columns by selection: count into bins, keep the bin that holds the rank, repeat."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bins that a round counts for each rank; each is one row for the driver.
BINS = 1024


def exact_medians(df: DataFrame, columns: Sequence[str], bins: int = BINS) -> dict[str, float | None]:
    """Median of each numeric column (the mean of the two middle values), null without values; NaN counts as missing.

    One pass gives counts and ranges; each further pass counts, for all columns at once, the values of the range that still holds a
    middle rank in bins with their least and greatest value.  A bin of one value ends the search.  No task or driver holds more than
    the bins, and a pass narrows a range by the number of bins.
    """
    value = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns}
    exact = df.agg(*[f(v).alias(f"{n}{i}") for i, v in enumerate(value.values()) for n, f in (("n", F.count), ("a", F.min), ("b", F.max))]).first() if columns else None
    found: dict[tuple[int, int], float] = {}
    search: dict[tuple[int, int], tuple[float, float, int]] = {}
    for i in range(len(columns)):
        n, low, high = exact[f"n{i}"], exact[f"a{i}"], exact[f"b{i}"]
        for rank in {(n - 1) // 2, n // 2} if n else ():
            if low == high:
                found[i, rank] = low
            else:
                search[i, rank] = (low, high, rank)
    while search:
        # both middle ranks of a column mostly search one range
        ranges = sorted({(i, low, high) for (i, _), (low, high, _) in search.items()})
        cells = []
        for k, (i, low, high) in enumerate(ranges):
            v = value[columns[i]]
            bin_of = F.least(F.floor((v / 2 - low / 2) / (high / 2 - low / 2) * bins), F.lit(bins - 1))
            cells.append(F.when((v >= low) & (v <= high), F.struct(F.lit(k).alias("k"), bin_of.cast("int").alias("bin"), v.alias("v"))))
        counted = df.select(F.explode(F.array(*cells)).alias("c")).filter("c IS NOT NULL").groupBy("c.k", "c.bin").agg(F.count("*").alias("n"), F.min("c.v").alias("low"), F.max("c.v").alias("high"))
        by_range: dict[int, list] = {}
        for r in counted.collect():
            by_range.setdefault(r.k, []).append(r)
        for (i, rank), (low, high, left) in list(search.items()):
            for r in sorted(by_range[ranges.index((i, low, high))], key=lambda r: r.bin):
                if left < r.n:
                    break
                left -= r.n
            if r.low == r.high:
                found[i, rank] = r.low
                del search[i, rank]
            else:
                search[i, rank] = (r.low, r.high, left)
    out: dict[str, float | None] = {}
    for i, c in enumerate(columns):
        n = exact[f"n{i}"]
        a, b = (found[i, (n - 1) // 2], found[i, n // 2]) if n else (None, None)
        out[c] = a if a == b else a + 0.5 * (b - a)
    return out
