"""Names that nothing else has: the first free one of a stem, stem_1, stem_2 and so on, row by row in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.sources.shared import written


def free_names(files: DataFrame, stem: str, order: str, taken: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """files with each stem replaced by a name that no row before it (by order, within by) and no row of taken has.

    What comes out is what a loop over the rows gives that asks for stem, stem_1, stem_2 until a name is free. Here all
    rows ask at once: a name goes to the first row that asks for it, the others ask for their next one, with all later
    rows of their stem, until no two ask for the same. Rounds are as many as clashes between different stems hang together.
    taken: by, and name. Orders come once within by.
    """
    own = Window.partitionBy(*by, stem).orderBy(order)
    # which suffixes of a stem are taken already; 0 is the stem itself
    rows = files.withColumns({"_place": F.row_number().over(own) - 1, "_gone": F.array().cast("array<int>")})
    if taken is not None:
        suffix = F.regexp_extract("name", r"_([1-9]\d{0,8})$", 1).try_cast("int")
        whole = F.struct(F.col("name").alias("of"), F.lit(0).alias("k"))
        cut = F.struct(F.regexp_replace("name", r"_[1-9]\d{0,8}$", "").alias("of"), suffix.alias("k"))
        both = taken.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.explode(F.array(whole, cut)).alias("_t")).where("_t.k is not null")
        gone = both.groupBy(*[f"_by_{c}" for c in by], F.col("_t.of").alias("_of")).agg(F.collect_set("_t.k").alias("_taken"))
        same = F.col(stem) == F.col("_of")
        for c in by:
            same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
        rows = rows.join(gone, same, "left").withColumn("_gone", F.coalesce("_taken", "_gone")).drop("_taken", "_of", *[f"_by_{c}" for c in by])
    rows = rows.withColumn("_ask", F.col("_place"))
    while True:
        free = F.filter(F.sequence(F.lit(0), F.col("_ask") + F.size("_gone")), lambda k: ~F.array_contains("_gone", k))
        k = F.when(F.size("_gone") == 0, F.col("_ask")).otherwise(F.get(free, F.col("_ask")))
        named = rows.withColumn("_k", k).withColumn("_name", F.when(F.col("_k") == 0, F.col(stem)).otherwise(F.concat(stem, F.lit("_"), F.col("_k").cast("string"))))
        lost = F.row_number().over(Window.partitionBy(*by, "_name").orderBy(order)) > 1
        asked = written(named.withColumn("_lost", lost), "names")
        if asked.where("_lost").isEmpty():
            return asked.withColumn(stem, F.col("_name")).select(*files.columns)
        # rows of a stem keep their order, so those behind one that lost move on too
        on = asked.withColumn("_ask", F.col("_ask") + F.col("_lost").cast("int"))
        rows = on.withColumn("_ask", F.max(F.col("_ask") - F.col("_place")).over(own) + F.col("_place")).drop("_k", "_name", "_lost")
