"""Packing rendered entries into parts of a bounded size, in order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pack(threads: Iterator[tuple[str, int, list[int] | None]], limit: int, header: int = 200) -> Iterator[tuple[str, int | None, int]]:
    """(thread, entry number, part): threads in order and whole (entry number None), unless one alone is too big; ``threads``: (name, size, sizes of
    the entries of one that is too big).

    A thread that fits goes into the open part, else into a new one. One that fits in none starts a new part if less than a quarter
    of the open one is left, and then goes entry by entry.
    """
    part, used = 1, header
    for thread, size, entries in threads:
        need = size + 2
        if used + need > limit:
            if header + need <= limit:
                part, used = part + 1, header
            elif limit - used < limit / 4 and used > header:
                part, used = part + 1, header
        if used + need <= limit:
            used += need
            yield thread, None, part
            continue
        for k, one in enumerate(entries if entries is not None else [size]):
            if used + one > limit and used > header:
                part, used = part + 1, header
            used += one
            yield thread, k, part


def packed(entries: DataFrame, limit: int = 200_000, header: int = 200) -> DataFrame:
    """``project, thread, entry_no, part`` of ``project, thread, first_s, entry_no, size``.

    Each part begins where the last one is full, so the fold over a project's threads is sequential by its nature; it gets one row a
    thread. Only threads that are larger than a part bring the sizes of their entries.
    """
    totals = entries.groupBy("project", "thread").agg(F.min("first_s").alias("first_s"), F.sum("size").cast("long").alias("size"))
    large = entries.join(totals.where(F.col("size") + 2 + header > limit).select("project", "thread"), ["project", "thread"], "left_semi")
    sizes = large.groupBy("project", "thread").agg(F.transform(F.array_sort(F.collect_list(F.struct("entry_no", F.col("size").cast("long").alias("size")))), lambda e: e["size"]).alias("sizes"))

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        order = frame.sort_values(["first_s", "thread"])
        threads = ((r.thread, int(r.size_), list(r.sizes) if r.sizes is not None else None) for r in order.rename(columns={"size": "size_"}).itertuples())
        rows = [(frame.project.iloc[0], t, k, p) for t, k, p in pack(threads, limit, header)]
        return pd.DataFrame(rows, columns=["project", "thread", "k", "part"]).astype({"k": "Int64"})

    folded = totals.join(sizes, ["project", "thread"], "left").groupBy("project").applyInPandas(work, "project string, thread string, k long, part long")
    pieces = folded.groupBy("project", "thread").agg(F.max(F.when(F.col("k").isNull(), F.col("part"))).alias("whole"))
    whole = entries.select("project", "thread", "entry_no").join(pieces, ["project", "thread"])
    split = folded.where("k is not null").select("project", "thread", F.col("k").alias("entry_no"), F.col("part").alias("own"))
    return whole.join(split, ["project", "thread", "entry_no"], "left").select("project", "thread", "entry_no", F.coalesce("whole", "own").alias("part"))
