"""Base examples of packs: validation, expansion of memory regions, missing labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ctxspark import constants as C
from ctxspark.functions import text as T
from ctxspark.functions.tokenizer import STAND_IN, Tokenizer
from ctxspark.operators.sequences import big, repeated, runs_of

COLUMNS = ["pack_id", "shard", "base_input_ids", "base_labels", "memory_strings", "memory_positions"]


def _at(ids: str, p: Column) -> Column:
    return F.get(F.col(ids), p)


def is_region(p: Column) -> Column:
    """Whether start, placeholder and end stand at a position."""
    ok = (_at("base_input_ids", p) == C.START_ID) & (_at("base_input_ids", p + 1) == C.MEMORY_ID) & (_at("base_input_ids", p + 2) == C.END_ID)
    return F.coalesce(ok, F.lit(False))


def verify(examples: DataFrame) -> DataFrame:
    """(example_id, n_strings, n_positions, n_bad, is_valid): positions that are no region; strings and positions must be as many."""
    none = lambda c: F.when(F.col(c).isNull(), F.lit(0)).otherwise(F.size(c)).cast("bigint")
    bad = F.coalesce(F.size(F.filter("memory_positions", lambda p: ~is_region(p))), F.lit(0))
    bad = F.when(F.col("memory_positions").isNull(), F.lit(0)).otherwise(bad).cast("bigint")
    return examples.select("example_id", none("memory_strings").alias("n_strings"), none("memory_positions").alias("n_positions"), bad.alias("n_bad")).withColumn("is_valid", (F.col("n_strings") == F.col("n_positions")) & (F.col("n_bad") == 0))


def valid(examples: DataFrame) -> DataFrame:
    """Examples with a region for each string; the others are dropped."""
    n = lambda c: F.when(F.col(c).isNull(), F.lit(0)).otherwise(F.size(c))
    regions = F.coalesce(F.forall("memory_positions", is_region), F.lit(True))
    return examples.where(F.col("base_input_ids").isNotNull() & (n("memory_strings") == n("memory_positions")) & regions)


def expand(examples: DataFrame, ratio: int = C.RATIO, tok: Tokenizer = STAND_IN) -> DataFrame:
    """Valid examples with ``input_ids``, ``labels``, ``spans``, ``latent_counts``, ``memory_ids`` and ``seq_len``.

    The placeholder of each region is repeated as often as its string has latents, at least once; a null string counts as
    empty. Labels of whole regions are IGNORE, missing labels are IGNORE everywhere. ``spans`` are half-open, in the order the regions are listed in.
    Ids are cut at the regions' places, in order, and put together again, so an example is gone through once whatever its number of regions.
    """
    e = valid(examples)
    strings = F.coalesce("memory_strings", F.array().cast("array<string>"))
    e = e.withColumn("memory_ids", F.transform(strings, lambda s: tok.embed_ids(F.coalesce(s, F.lit("")))))
    e = e.withColumn("latent_counts", F.transform("memory_ids", lambda m: T.latent_count(F.size(m).cast("bigint"), ratio)))
    listed = F.arrays_zip(F.coalesce("memory_positions", F.array().cast("array<int>")).alias("p"), F.col("latent_counts").alias("k"))
    e = e.withColumn("at", F.array_sort(F.transform(listed, lambda z, i: F.struct(z["p"].alias("p"), z["k"].alias("k"), i.alias("i")))))
    # a piece ends with a region's start marker; between two pieces are the placeholders
    begins = F.concat(F.array(F.lit(0)), F.transform("at", lambda z: z["p"] + 2))
    ends = F.concat(F.transform("at", lambda z: z["p"] + 1), F.array(F.size("base_input_ids")))
    counts = F.transform("at", lambda z: z["k"])
    z = F.arrays_zip(begins.alias("b"), ends.alias("e"), counts.alias("k"))
    none = F.array().cast("array<bigint>")
    more = lambda x, k: F.when(k.isNull(), none).otherwise(repeated(x, k))
    ids = F.flatten(F.transform(z, lambda x: F.concat(F.slice("base_input_ids", x["b"] + 1, x["e"] - x["b"]), more(C.MEMORY_ID, x["k"]))))
    own = F.coalesce("base_labels", F.transform("base_input_ids", lambda x: big(C.IGNORE)))
    ignore = F.array(big(C.IGNORE))

    def kept(x: Column, i: Column) -> Column:
        """A piece's labels without those of the markers at its ends."""
        first, last = F.when(i > 0, F.lit(1)).otherwise(F.lit(0)), F.when(x["k"].isNotNull(), F.lit(1)).otherwise(F.lit(0))
        inner = F.slice(own, x["b"] + 1 + first, F.greatest(F.lit(0), x["e"] - x["b"] - first - last))
        return F.concat(F.when(i > 0, ignore).otherwise(none), inner, F.when(x["k"].isNotNull(), ignore).otherwise(none), more(C.IGNORE, x["k"]))

    labels = F.flatten(F.transform(z, kept))
    extra = T.prefix_sums(F.transform("at", lambda x: x["k"] - 1))
    sorted_spans = F.zip_with("at", F.slice(extra, 1, F.size("at")), lambda x, o: F.struct(x["i"].alias("i"), (x["p"] + 1 + o).alias("start"), (x["p"] + 1 + o + x["k"]).alias("end")))
    spans = F.transform(F.array_sort(sorted_spans), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    out = e.withColumns({"input_ids": ids, "labels": labels, "spans": spans}).drop("at")
    return out.withColumn("seq_len", F.size("input_ids").cast("bigint"))


def placeholder_runs(examples: DataFrame) -> DataFrame:
    """(example_id, run_start, run_end): maximal runs of placeholder ids, half-open, found without positions."""
    e = examples.where("base_input_ids is not null").select("example_id", F.explode(runs_of(F.col("base_input_ids"), C.MEMORY_ID)).alias("r"))
    return e.select("example_id", F.col("r.start").alias("run_start"), F.col("r.end").alias("run_end"))
