"""Named corpora and treebanks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Name, language code, treebank, folder of the converted text, own tokenization kept
# (no retokenizing), multiword tokens not expanded.
CATALOG = [
    ("coptic", "cop", "UD_Coptic-Scriptorium", "data/coptic/converted", True, False),
    ("english", "en", "UD_English-GUM", "data/english/converted", True, False),
    ("greek", "grc", "UD_Ancient_Greek-PROIEL", "data/greek/converted", False, True),
    ("indonesian", "id", "UD_Indonesian-GSD", "data/indonesian/converted_punct", False, False),
    ("maltese", "mt", "UD_Maltese-MUDT", "data/maltese/converted_punct", False, True),
    ("tamil", "ta", "UD_Tamil-TTB", "data/tamil/converted_punct", False, False),
    ("uyghur", "ug", "UD_Uyghur-UDT", "data/uyghur/converted_punct", False, True),
    ("wolof", "wo", "UD_Wolof-WTB", "data/wolof/converted_punct", False, False),
]
SCHEMA = "name string, code string, treebank string, text_folder string, keep_tokens boolean, no_mwt boolean"


def catalog(spark: SparkSession) -> DataFrame:
    """The catalog as a table of eight rows."""
    return spark.createDataFrame(CATALOG, SCHEMA)


def shortcut(name: str) -> dict:
    """One catalog entry with its train and dev folders; an unknown name is an error."""
    for row in CATALOG:
        if row[0] == name:
            keys = [c.split()[0] for c in SCHEMA.split(", ")]
            entry = dict(zip(keys, row))
            return {**entry, "train": f"{entry['text_folder']}/train", "dev": f"{entry['text_folder']}/dev"}
    raise ValueError(f"unknown shortcut: {name}")
