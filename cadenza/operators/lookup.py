"""Values of a text's words, word by word, without moving every word.

The ``HOT`` most frequent words (a fixed number) are looked up where the text is, in Arrow batches; only
the distinct other words of a row are shuffled to their values and back.  A row travels once, as two strings,
its words and their values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from cadenza.operators.corpus import settled

HOT = 200_000
UNKNOWN = "?"       # in the place of a value that is still to be found; no value is one, has one or a "|" in it


def _looked(words, values, missing: bool):
    """Rows with ``ws`` replaced by ``line, vals``, or (``missing``) by ``cold``, the words that are not among ``words``."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        for batch in batches:
            ws = batch.column(batch.num_columns - 1)
            offsets = ws.offsets.to_numpy()
            flat = ws.values.slice(offsets[0], offsets[-1] - offsets[0])
            offsets = (offsets - offsets[0]).astype(np.int32)
            code = flat.dictionary_encode()
            found = values.take(pc.index_in(code.dictionary, words))
            if missing:
                cold = found.is_null().to_numpy(zero_copy_only=False)[code.indices.to_numpy()]
                before = np.concatenate([[0], np.cumsum(cold)]).astype(np.int32)
                out = {"cold": pa.ListArray.from_arrays(pa.array(before[offsets]), flat.filter(pa.array(cold)))}
            else:
                vals = found.fill_null(UNKNOWN).take(code.indices)
                out = {"line": pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), flat), " "),
                       "vals": pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), vals), "|")}
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *out.values()], [*batch.schema.names[:-1], *out])
    return run


def word_values(rows: DataFrame, keys: list[str], value: Callable[[DataFrame], DataFrame], order: Callable[[Column], Column] | None = None,
                hot: int = HOT) -> DataFrame:
    """``keys, line, vals`` of ``rows`` (``keys, ws``: rows with a word): the words joined by a space and their values by ``|``.
    ``value`` gives ``word, value`` of every one of the distinct words it gets (``word, n``: how often).  Rows of
    equal keys become one, by position, then ``order`` of the value (the word, if not given)."""
    from cadenza.session import ensure_checkpoint_dir
    spark = rows.sparkSession
    ensure_checkpoint_dir(spark)
    rows = rows.where(F.size("ws") > 0).select(*keys, "ws")
    count = rows.select(F.explode("ws").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    table = value(count).select("word", "n", "value").checkpoint()
    top = table.orderBy(F.desc("n"), "word").limit(hot).select("word", "value").toArrow().combine_chunks()
    words, values = ((c.chunk(0) if c.num_chunks else c.combine_chunks()).cast("string") for c in (top.column(0), top.column(1)))
    own = [rows.schema[k] for k in keys]
    x = rows.mapInArrow(_looked(words, values, False), StructType([*own, StructField("line", StringType()), StructField("vals", StringType())]))
    # the texts are cut a second time for the unknown words: cheaper than to take whole rows to the join
    cold = rows.mapInArrow(_looked(words, values, True), StructType([*own, StructField("cold", ArrayType(StringType()))])).where(F.size("cold") > 0)
    cold = settled(cold.select(*keys, F.array_distinct("cold").alias("cold"))).select(*keys, F.explode("cold").alias("word")).join(table.select("word", "value"), "word")
    t = x.unionByName(cold, allowMissingColumns=True)
    t = t.repartition(*keys)        # rows as they are: few of a key lie together before
    whole = F.when(F.col("line").isNotNull(), F.struct("line", "vals"))
    hit = F.when(F.col("line").isNull(), F.struct("word", "value"))
    g = t.groupBy(*keys).agg(F.collect_list(whole).alias("own"), F.collect_set(hit).alias("hits"))
    g = settled(g.select(*keys, "own", F.map_from_entries("hits").alias("hits"),
                         ((F.size("own") == 1) & (F.size("hits") == 0)).alias("whole")))

    def entries(r: Column) -> Column:
        both = F.arrays_zip(F.split(r["line"], " ").alias("w"), F.split(r["vals"], "\\|").alias("v"))
        v = (lambda x: F.when(x["v"] == UNKNOWN, F.try_element_at("hits", x["w"])).otherwise(x["v"]))
        e = F.transform(both, lambda x, i: F.struct(i.alias("i"), x["w"].alias("w"), v(x).alias("v")))
        return F.transform(e, lambda x: F.struct(x["i"].alias("i"), (order(x["v"]) if order else x["w"]).alias("o"), x["w"].alias("w"), x["v"].alias("v")))
    every = F.flatten(F.transform("own", entries))
    mixed = F.when(~F.col("whole"), F.when(F.size("own") > 1, F.sort_array(every)).otherwise(every))
    g = settled(g.select(*keys, F.get("own", F.lit(0)).alias("r"), "whole", mixed.alias("m")))
    return g.select(*keys, F.when(F.col("whole"), F.col("r.line")).otherwise(F.array_join("m.w", " ")).alias("line"),
                    F.when(F.col("whole"), F.col("r.vals")).otherwise(F.array_join("m.v", "|")).alias("vals"))
