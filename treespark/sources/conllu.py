"""CoNLL-U sources: blocks of tab-separated lines, one block per sentence, comments first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treespark.functions.arrays import computed
from treespark.operators.tokens import is_integer_id
from treespark.sources.records import read_records

# Positions of the fields in a line, and the mark of an empty field.
FIELDS = {"id": 0, "form": 1, "lemma": 2, "upos": 3, "xpos": 4, "feats": 5, "head": 6, "deprel": 7}
EMPTY = "_"
SPLITS = ("train", "dev", "test")
#: The first ``.conllu`` entry on a path, a file or a folder of parts: the path up to it, and its name.
ENTRY = r"^(.*?([^/]*\.conllu))(/|$)"


def _words(block: Column) -> Column:
    """Structs of the fields used; an empty tag or head is null."""
    lines = F.filter(F.split(block, "\n"), lambda x: (F.length(F.trim(x)) > 0) & ~x.startswith("#"))

    def word(parts: Column) -> Column:
        field = lambda name: F.get(parts, F.lit(FIELDS[name]))
        return F.struct(
            field("id").alias("id"),
            field("form").alias("form"),
            F.nullif(field("xpos"), F.lit(EMPTY)).alias("xpos"),
            F.nullif(field("head"), F.lit(EMPTY)).alias("head"),
            field("deprel").alias("deprel"),
        )

    return F.transform(F.transform(lines, lambda x: F.split(x, "\t| {2,}")), word)


def comment(block: Column, key: str) -> Column:
    """The value of a ``# key = value`` comment, null without one."""
    found = F.regexp_extract(block, rf"(?m)^#\s*{key}\s*=\s*(.*?)\s*$", 1)
    return F.nullif(found, F.lit(""))


def meta(block: Column) -> Column:
    """All ``# key = value`` comments as a map; the last of equal keys counts."""
    lines = F.filter(F.split(block, "\n"), lambda x: x.rlike(r"^#[^=]*="))
    entry = lambda x: F.struct(
        F.trim(F.regexp_extract(x, r"^#([^=]*)=", 1)).alias("k"),
        F.trim(F.regexp_extract(x, r"^#[^=]*=(.*)$", 1)).alias("v"),
    )
    entries = F.transform(lines, entry)
    last = F.filter(
        entries,
        lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["k"] == e["k"]),
    )
    return F.map_from_entries(last)


def blocks(lines: DataFrame, column: str = "value") -> DataFrame:
    """One row per sentence block. A row may hold several where blank lines carry blanks or carriage returns."""
    text = F.regexp_replace(column, "\r", "")
    parts = lines.select(
        *[c for c in lines.columns if c != column], F.explode(F.split(text, r"\n[ \t]*\n")).alias("block")
    )
    return parts.where(F.col("block").rlike(r"(?m)^[^#\s]"))


def _read_blocks(spark: SparkSession, paths: str | list[str], glob: str | None = None) -> DataFrame:
    """(sent_id, path, block) of the sentences of files and folder trees, whatever their line ends and blank lines.

    Ids are byte offsets (``records.read_records``): distinct over all files of the read, and the same in every read.
    """
    return read_records(spark, paths, glob).where(F.col("block").rlike(r"(?m)^[^#\s]"))


def parse_blocks(df: DataFrame, plain_ids_only: bool = True) -> DataFrame:
    """Replace ``block`` by tokens, xpos, head and deprel arrays (heads still strings)."""
    words = _words(F.col("block"))
    if plain_ids_only:
        words = F.filter(words, lambda w: is_integer_id(w["id"]))
    parsed = computed(df, _w=words)
    names = {"tokens": "form", "xpos": "xpos", "head": "head", "deprel": "deprel"}
    return parsed.select(
        *[c for c in df.columns if c != "block"],
        *[F.col("_w")[f].alias(n) for n, f in names.items()],
    )


def read_conllu(
    spark: SparkSession, path: str, split: str = "train", keys: tuple[str, ...] = (), glob: str | None = None
) -> DataFrame:
    """(sent_id, split, tokens, xpos, head, deprel, keys…) of plain words; ``keys`` are comments to keep.

    With ``glob`` the path is searched recursively for matching files. Ids are distinct within a read, follow the
    order of blocks within a file and stay the same in every read; read files together rather than one by one to unite
    them.
    """
    return _parsed(_read_blocks(spark, path, glob).drop("path").withColumn("split", F.lit(split)), keys)


def _parsed(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    rows = rows.withColumns({f"meta_{k}": comment(F.col("block"), k) for k in keys}) if keys else rows
    return parse_blocks(rows)


def read_conllu_forms(spark: SparkSession, path: str, split: str = "train", glob: str | None = "*.conllu") -> DataFrame:
    """(sent_id, split, tokens) of all lines, ranges and empty nodes included, from a file or a folder tree."""
    rows = _read_blocks(spark, path, None if path.endswith(".conllu") else glob).drop("path")
    return parse_blocks(rows.withColumn("split", F.lit(split)), plain_ids_only=False).select("sent_id", "split", "tokens")


def read_conllu_meta(
    spark: SparkSession, path: str, keys: tuple[str, ...] = ("s_type", "text"), glob: str | None = None
) -> DataFrame:
    """(sent_id, keys…): comment values per sentence."""
    return _read_blocks(spark, path, glob).select("sent_id", *[comment(F.col("block"), k).alias(k) for k in keys])


def treebank_files(spark: SparkSession, folder: str) -> dict[str, str]:
    """Split -> path of a treebank folder, which must hold exactly three ``.conllu`` entries."""
    found = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(folder)
        .select(F.regexp_extract("path", ENTRY, 1).alias("path"))
        .where("path <> ''")
        .distinct()
        .limit(4)
    )
    paths = [r["path"] for r in found.collect()]
    if len(paths) != 3:
        raise ValueError("a treebank needs exactly three .conllu files: train, dev and test")
    by_split = {s: [p for p in paths if p.endswith(f"{s}.conllu")] for s in SPLITS}
    if any(len(p) != 1 for p in by_split.values()):
        raise ValueError(f"cannot tell train, dev and test apart in {paths}")
    return {s: p[0] for s, p in by_split.items()}


def read_treebank(spark: SparkSession, folder: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """The three splits of a treebank folder as one table with distinct ids."""
    files = treebank_files(spark, folder)
    rows = _read_blocks(spark, list(files.values()))
    entry = F.regexp_extract("path", ENTRY, 2)
    split = F.coalesce(*[F.when(entry.endswith(f"{s}.conllu"), s) for s in SPLITS])
    return _parsed(rows.withColumn("split", split).drop("path"), keys)
