"""Quality rules with thresholds from the data: mergeable quantile sketches per language and source. Native.

The sketch of a measure is a log-linear histogram: integers below 32 have a bin each; above, every power of two is cut
into 32 bins, so a quantile read from it is off by 1/32 of its value at most. Bins are integers, merging is adding
counts, and neither the order nor the partitioning of the rows changes the result.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BLANK_CHARS, blank_words, cut, lookup

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Fence:
    """A measure's limits in a language and source: the quantile at `high` percent plus `spread` times a distance, and with
    `both` also the quantile at `low` percent minus as much.

    The distance is that of the two quantiles. A measure that is the same in most texts of a group has none; there it is
    what `step` more of the thing counted makes in a text of the group's median length, by the sketch of `per`. Without
    `per` it is the width of the sketch's bin at the upper quantile.
    """

    low: int
    high: int
    spread: int
    step: int = 0
    per: str | None = None
    both: bool = False


#: Measures are shares in units of 1/10000, but for mean_chars (1/100 of a code point). Measures that are 0 in most
#: texts are judged by their upper tail; symbols by quartiles, as these stand up to a quarter of bad documents. The steps
#: are one symbol, one line, and a window of three words and its repeat.
FENCES: Mapping[str, Fence] = {
    "symbol_rate": Fence(25, 75, 6, 1, "n_words"),
    "dup_line_rate": Fence(50, 95, 3, 1, "n_lines"),
    "repeat_rate": Fence(50, 95, 8, 6, "n_words"),
    "mean_chars": Fence(10, 90, 3, both=True),
}
#: Lengths, which have sketches as well.
LENGTHS = ("n_words", "n_lines")
#: Every group's sketch is merged with a prior of so many rows: the sketch of its language, scaled down, and as far as
#: that has fewer rows the sketch of all. So limits of small groups lean on their language, and those of large ones do not.
PRIOR_ROWS = 100
BIN_BITS = 5


def _line_words(text: Column) -> Column:
    """The lines of a text that hold a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: F.btrim(line, F.lit(BLANK_CHARS)) != "")


def measured(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns `keep`), packed in a struct `__row`, with the measures of each whole text.

    Null and empty texts measure 0 everywhere. Columns of docs may have any names, as they stay in the struct.

    Each step is a projection of its own, so that word and window arrays are built once a row.
    """
    rows = docs.select(F.struct(*(keep or ["*"])).alias("__row"), F.col(text).alias("__text"))
    rows = rows.withColumns({"__words": blank_words(F.col("__text")), "__lines": _line_words(F.col("__text"))})
    words, lines, whole = F.col("__words"), F.col("__lines"), F.coalesce("__text", F.lit(""))
    last = F.size(words) - 3
    window = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    rows = rows.withColumns(
        {
            "n_words": F.size(words).cast("long"),
            "word_chars": F.char_length(F.array_join(words, "")).cast("long"),
            "n_symbols": (F.char_length(whole) - F.char_length(F.translate(whole, SYMBOLS, ""))).cast("long"),
            "n_lines": F.size(lines).cast("long"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            # windows of three words, equal ones side by side
            "__sorted": F.when(last >= 0, F.sort_array(window)).otherwise(none),
        }
    ).drop("__text", "__words", "__lines")
    near = F.col("__sorted")
    twins = F.filter(near, lambda x, i: (x["h"] == F.get(near, i - 1)["h"]) | (x["h"] == F.get(near, i + 1)["h"]))
    rows = rows.withColumn("__twins", F.transform(twins, lambda x: x["i"])).drop("__sorted")
    places = F.flatten(F.transform(F.col("__twins"), lambda i: F.array(i, i + 1, i + 2)))
    rows = rows.withColumn("n_repeat_words", F.size(F.array_distinct(places)).cast("long")).drop("__twins")
    return rows


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def rates() -> dict[str, Column]:
    """The measures with fences, as integers. A text without words or lines has 0."""

    def share(part: str, whole: str, unit: int) -> Column:
        return F.when(F.col(whole) > 0, F.floor(F.col(part) * unit / F.col(whole))).otherwise(F.lit(0)).cast("long")

    return {
        "symbol_rate": share("n_symbols", "n_words", 10_000),
        "dup_line_rate": share("n_dup_lines", "n_lines", 10_000),
        "repeat_rate": share("n_repeat_words", "n_words", 10_000),
        "mean_chars": share("word_chars", "n_words", 100),
    }


def bin_of(value: Column) -> Column:
    """The sketch's bin of an integer from 0 on: bins ascend with their values."""
    octave = F.greatest(F.length(F.bin(value)) - 1 - BIN_BITS, F.lit(0))
    return (octave * (1 << BIN_BITS) + F.call_function("shiftright", value, octave)).cast("int")


def bin_top(cell: Column) -> Column:
    """The largest integer in a bin."""
    half = 1 << BIN_BITS
    octave = F.greatest(F.floor(cell / half) - 1, F.lit(0)).cast("int")
    return F.call_function("shiftleft", (cell - octave * half + 1).cast("long"), octave) - 1


def sketch(rows: DataFrame) -> DataFrame:
    """(lang, source, measure, bin, n): one mergeable sketch for each language, source and measure.

    Only rows that pass the base rules count: a source full of junk does not raise its own limits. The counts are
    summed on the map side first, so a hot source sends a few hundred rows a task.
    """
    good = rows.filter(~base_failed())
    cells = F.array(*[F.struct(F.lit(m).alias("measure"), bin_of(F.col(m)).alias("bin")) for m in (*FENCES, *LENGTHS)])
    return good.select("lang", "source", F.explode(cells).alias("c")).groupBy("lang", "source", "c.measure", "c.bin").agg(F.count(F.lit(1)).alias("n"))


def merged(cells: DataFrame, groups: DataFrame, prior_rows: int = PRIOR_ROWS) -> DataFrame:
    """(lang, source, measure, bin, n) of each group: its own sketch, merged with a prior of its language and of all rows.

    Counts are whole numbers in units of 1 / (rows of the language * rows of all), so merging stays exact.
    """
    of_lang = cells.groupBy("lang", "measure", "bin").agg(F.sum("n").alias("n"))
    of_all = cells.groupBy("measure", "bin").agg(F.sum("n").alias("n"))  # a few thousand bins, whatever the corpus
    one = next(iter(FENCES))  # every good row has one value of each measure
    lang_rows = of_lang.filter(F.col("measure") == one).groupBy(F.col("lang").alias("_lang")).agg(F.sum("n").alias("_l"))
    all_rows = of_all.filter(F.col("measure") == one).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("_a"))
    sized = groups.join(lang_rows, F.col("lang").eqNullSafe(F.col("_lang")), "left").drop("_lang").join(F.broadcast(all_rows))
    long = lambda c: F.greatest(F.coalesce(c, F.lit(0)), F.lit(1)).cast("decimal(38,0)")
    own = F.least(F.coalesce("_l", F.lit(0)), F.lit(prior_rows))
    sized = sized.select("lang", "source", long("_l").alias("rows_lang"), long("_a").alias("rows_all"), own.alias("from_lang"), (F.lit(prior_rows) - own).alias("from_all"))
    key = lambda a, b: F.col(f"{a}.lang").eqNullSafe(F.col(f"{b}.lang"))
    columns = lambda t, n: ["g.lang", "g.source", f"{t}.measure", f"{t}.bin", n.alias("n")]
    g, n = sized.alias("g"), F.col("n").cast("decimal(38,0)")
    fine = g.join(cells.alias("f"), key("g", "f") & F.col("g.source").eqNullSafe(F.col("f.source"))).select(*columns("f", n * F.col("rows_lang") * F.col("rows_all")))
    # most groups lean on their language alone, or on nothing
    leans, alone = sized.filter("from_lang > 0").alias("g"), sized.filter("from_all > 0").alias("g")
    mid = leans.join(of_lang.alias("c"), key("g", "c")).select(*columns("c", n * F.col("from_lang") * F.col("rows_all")))
    top = alone.join(F.broadcast(of_all).alias("a")).select(*columns("a", n * F.col("from_all") * F.col("rows_lang")))
    return fine.unionByName(mid).unionByName(top).groupBy("lang", "source", "measure", "bin").agg(F.sum("n").cast("decimal(38,0)").alias("n"))


def limits(rows: DataFrame, prior_rows: int = PRIOR_ROWS) -> DataFrame:
    """(lang, source, max_ and min_ of each measure) for each language and source of the rows, read from merged sketches.

    All are null if no row passes the base rules. min_ is null for measures without a lower limit.
    """
    cells = cut(sketch(rows), "sketch")
    groups = cut(rows.select("lang", "source").distinct(), "groups")
    up = Window.partitionBy("lang", "source", "measure").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("lang", "source", "measure")
    ranked = merged(cells, groups, prior_rows).withColumns({"below": F.sum("n").over(up), "rows": F.sum("n").over(whole)})
    at = lambda m, percent: F.min(F.when((F.col("measure") == m) & (F.col("below") * 100 >= F.col("rows") * percent), bin_top(F.col("bin"))))
    quantiles = [at(m, p).alias(f"{k}_{m}") for m, f in FENCES.items() for k, p in (("low", f.low), ("high", f.high))]
    read = ranked.groupBy("lang", "source").agg(*quantiles, *[at(m, 50).alias(f"median_{m}") for m in LENGTHS])
    out = []
    for m, f in FENCES.items():
        low, high = F.col(f"low_{m}"), F.col(f"high_{m}")
        step = F.floor(F.lit(f.step * 10_000) / F.greatest(F.col(f"median_{f.per}"), F.lit(1))) if f.per else F.floor(high / (1 << BIN_BITS))
        reach = f.spread * F.greatest(high - low, step.cast("long"))
        out += [(high + reach).alias(f"max_{m}"), (low - reach if f.both else F.lit(None).cast("long")).alias(f"min_{m}")]
    return read.select("lang", "source", *out)


def judged(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", keep: list[str] | None = None, prior_rows: int = PRIOR_ROWS) -> DataFrame:
    """Each row of docs (or its columns `keep`), in `__row`, with its measures, base_failed and kept.

    kept: not base_failed, and every rate within the limits of the row's language and source. The measured rows are written
    once and serve both the sketches and the verdicts. Null languages and sources are groups of their own. An empty
    table gives an empty result.
    """
    carried = [*keep, *({lang, source} - {*keep})] if keep else None
    rows = measured(docs, text, carried).withColumns({"lang": F.col(f"__row.{lang}"), "source": F.col(f"__row.{source}")})
    rows = cut(rows.withColumns(rates()), "measured")
    table = cut(limits(rows, prior_rows), "limits")
    joined = lookup(rows, table, ["lang", "source"])
    within = F.lit(True)
    for m in FENCES:
        within = within & F.coalesce(F.col(m) <= F.col(f"max_{m}"), F.lit(True)) & F.coalesce(F.col(m) >= F.col(f"min_{m}"), F.lit(True))
    return joined.withColumns({"base_failed": base_failed(), "kept": ~base_failed() & within})


def quality_filter(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of docs that the rules keep, with the columns of docs.

    Null and empty texts fail the base rules and go. Repeated rows share their verdict. An empty table stays empty.
    """
    return judged(docs, text, lang, source).filter("kept").select("__row.*")
