"""Settings in layers, and the companies that a period can belong to."""

from __future__ import annotations

import os
import re
from collections import ChainMap
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, make_dataclass

from pyspark.sql import DataFrame, SparkSession

#: A line of a settings file: a name, and a value that may stand in quotes.
LINE = re.compile(r"""^[^\S\n]*(?P<name>[^#=\s][^=\n]*?)[^\S\n]*=[^\S\n]*(?P<quote>["']*)(?P<value>.*?)["'\s]*$""", re.MULTILINE)


def layered(file_text: str = "", environment: Mapping[str, str] | None = None, overrides: Mapping[str, object] | None = None) -> Mapping[str, str]:
    """Settings looked up in the overrides that are given, then in the environment, then in the text of a file."""
    given = {name: str(value) for name, value in (overrides or {}).items() if value is not None}
    own = dict(os.environ) if environment is None else dict(environment)
    return ChainMap(given, own, {m["name"]: m["value"] for m in LINE.finditer(file_text)})


#: What is known of the transcription service: the name of each setting, what makes its value of a text, and the default.
READER = (("url", str, ""), ("token", str, None), ("header", str, "Authorization"), ("timeout", float, 120.0), ("attempts", int, 3), ("concurrency", int, 8))


def _of(cls, settings: Mapping[str, str], prefix: str = "LEDGERLOOM_READER_"):
    """Blank settings count as not given; the address must be."""
    texts = {name: str(settings.get(prefix + name.upper()) or "").strip() for name, _, _ in READER}
    if not texts["url"]:
        raise ValueError(f"{prefix}URL is not set")
    return cls(**{name: kind(texts[name]) for name, kind, _ in READER if texts[name]})


#: How the transcription service is called.
Reader = make_dataclass("Reader", [(name, kind, field(default=default)) for name, kind, default in READER], frozen=True, namespace={"of": classmethod(_of)}, module=__name__)


@dataclass(frozen=True)
class Company:
    name: str
    aliases: Sequence[str] = ()
    legal_names: Sequence[str] = ()
    tax_ids: Sequence[str] = ()
    branch_codes: Sequence[str] = ()
    report_names: Sequence[str] = field(default=())


def company_texts(spark: SparkSession, companies: Sequence[Company]) -> DataFrame:
    """company, alias: every name by which a text may mean a company."""
    rows = [(c.name, t) for c in companies for t in (*c.aliases, *c.legal_names, *c.report_names)]
    return spark.createDataFrame(rows, "company string, alias string")


def company_codes(spark: SparkSession, companies: Sequence[Company]) -> DataFrame:
    """company, kind (branch, tax_id), code as it is normalised."""
    from pyspark.sql import functions as F

    from ledgerloom.functions.codes import normalize_branch_code, normalize_tax_id

    rows = [(c.name, kind, x) for c in companies for kind, values in (("branch", c.branch_codes), ("tax_id", c.tax_ids)) for x in values]
    made = spark.createDataFrame(rows, "company string, kind string, raw string")
    code = F.when(F.col("kind") == "branch", normalize_branch_code(F.col("raw"))).otherwise(normalize_tax_id(F.col("raw")))
    return made.select("company", "kind", code.alias("code"))


def selected(companies: Sequence[Company], name: str) -> Company:
    for c in companies:
        if c.name == name:
            return c
    raise ValueError(f"unknown company {name!r}")


def identified(companies: Sequence[Company], name: str) -> bool:
    """Whether a company has tax ids or branch codes by which its sources can be told."""
    own = selected(companies, name)
    return bool(own.tax_ids or own.branch_codes)
