"""Activity records: typed rows from JSON, and a paged REST source."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from importlib import import_module
from urllib.parse import urlencode, urljoin

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition

from .tables import RAW

RECORD = (
    "target_chembl_id string, target_pref_name string, molecule_chembl_id string, canonical_smiles string, standard_type string, standard_relation string, "
    "pchembl_value string, assay_chembl_id string, document_chembl_id string, document_year int, data_validity_comment string, potential_duplicate string"
)
PAUSES = (2, 4, 8, 16)


#: Types of measurement that make tasks.
TYPES = ("IC50", "Ki")


def parse(records: DataFrame, assays: DataFrame | None = None, types: tuple[str, ...] | None = TYPES) -> DataFrame:
    """Raw rows of the records that are exact measurements: a type among ``types``, relation '=', a value, no doubt on validity, no
    potential duplicate, a structure, a year, and an assay among ``assays`` where given."""
    value = F.expr("try_cast(pchembl_value AS double)")
    keep = (
        (F.col("standard_relation") == "=") & value.isNotNull() & (F.coalesce("data_validity_comment", F.lit("")) == "")
        & ~F.lower(F.coalesce("potential_duplicate", F.lit("0"))).isin("1", "true") & (F.coalesce("canonical_smiles", F.lit("")) != "") & F.col("document_year").isNotNull()
    )
    rows = records.where(keep if types is None else keep & F.col("standard_type").isin(*types))
    if assays is not None:
        rows = rows.join(assays.select("assay_chembl_id").distinct(), "assay_chembl_id", "left_semi")
    return rows.select(
        F.col("target_chembl_id").alias("target_id"), F.col("target_pref_name").alias("target_name"), F.col("molecule_chembl_id").alias("molecule_id"),
        F.col("canonical_smiles").alias("structure"), "standard_type", value.alias("value"), F.col("assay_chembl_id").alias("assay_id"),
        F.col("document_chembl_id").alias("doc_id"), F.col("document_year").alias("doc_year"), F.col("data_validity_comment").alias("validity_comment"),
    )


def confident(assays: DataFrame, least: int = 8, kind: str = "B") -> DataFrame:
    return assays.where((F.col("confidence_score") >= least) & (F.col("assay_type") == kind))


def fetch(get: Callable[[str], str], url: str, pause: Callable[[float], None] = time.sleep) -> dict:
    """A page's JSON; four further attempts after 2, 4, 8 and 16 seconds, then the error itself."""
    for wait in (*PAUSES, None):
        try:
            return json.loads(get(url))
        except (OSError, ValueError):
            if wait is None:
                raise
            pause(wait)
    raise AssertionError


def pages(get: Callable[[str], str], url: str, key: str, pause: Callable[[float], None] = time.sleep):
    """Every record under ``key``, following page_meta.next, which may be relative to the page, to its end."""
    while url:
        page = fetch(get, url, pause)
        yield from page[key]
        following = (page.get("page_meta") or {}).get("next")
        url = urljoin(url, following) if following else None


def http_get(url: str) -> str:
    from urllib.request import urlopen

    with urlopen(url, timeout=60) as answer:
        return answer.read().decode()


#: What the service is asked to leave out; parse() checks again.
FILTERS = {"standard_relation": "=", "pchembl_value__isnull": "false", "assay_type": "B", "data_validity_comment__isnull": "true", "limit": "1000"}
#: Columns whose equality the service takes as a filter of the same name.
SERVED = ("target_chembl_id", "standard_type", "molecule_chembl_id", "assay_chembl_id", "document_chembl_id", "document_year")


class _Target(InputPartition):
    def __init__(self, target: str, kind: str):
        super().__init__((target, kind))


class _Reader(DataSourceReader):
    def __init__(self, options: dict, names: list[str]):
        self.options, self.names, self.asked = options, names, {}

    def partitions(self):
        return [_Target(t, k) for t in self.options["targets"].split(",") for k in self.options.get("types", "IC50,Ki").split(",")]

    def read(self, partition):
        target, kind = partition.value
        get = _transport(self.options.get("get"))
        url = f"{self.options['url']}?{urlencode({'target_chembl_id': target, 'standard_type': kind} | FILTERS | self.asked)}"
        for r in pages(get, url, "activities"):
            values = [r.get(n) for n in self.names]
            yield tuple(v if v is None or n == "document_year" else str(v) for n, v in zip(self.names, values))


class _PushingReader(_Reader):
    def pushFilters(self, filters):
        """Equalities that the service knows go to it; Spark checks the others, and those of targets and types again, which are lists."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == (f.attribute[0],) and f.attribute[0] in SERVED[2:]:
                self.asked[f.attribute[0]] = str(f.value)
            else:
                yield f


def _transport(name: str | None) -> Callable[[str], str]:
    """``module:function``, or plain HTTP."""
    if not name:
        return http_get
    module, _, function = name.partition(":")
    return getattr(import_module(module), function)


class Activities(DataSource):
    """``spark.read.format("activities")``, options url, targets, types and get, the transport as ``module:function``: one partition for
    each target and type. With the option push, equalities on served columns are asked of the service; Spark wants
    spark.sql.python.filterPushdown.enabled for that."""

    @classmethod
    def name(cls):
        return "activities"

    def schema(self):
        return RECORD

    def reader(self, schema):
        kind = _PushingReader if str(self.options.get("push", "")).lower() == "true" else _Reader
        return kind(dict(self.options), [f.name for f in schema.fields])


CATALOGUE = (
    "owner struct<slug:string>, slug string, nRows long, tableContent struct<size:long>, createdAt string, userAttributes struct<year:string>, source string, license string, "
    "tags array<string>, annotations map<string,struct<modality:string>>"
)


def catalogue(datasets: DataFrame, today: str | None = None) -> DataFrame:
    """A nested catalogue (``CATALOGUE``) flattened: owner, slug, n_rows, table_bytes, created, year, source, license, tags packed, names of
    the columns that hold molecules, and the day it was read; whatever is missing is null, and empty where it is packed."""
    packed = lambda c: F.coalesce(F.array_join(c, ";"), F.lit(""))
    return datasets.select(
        F.col("owner.slug").alias("owner"), "slug", F.col("nRows").alias("n_rows"), F.col("tableContent.size").alias("table_bytes"), F.substring("createdAt", 1, 10).alias("created"),
        F.col("userAttributes.year").alias("year"), "source", "license", packed("tags").alias("tags"),
        packed(F.array_sort(F.map_keys(F.map_filter("annotations", lambda k, v: F.coalesce(v["modality"] == "MOLECULE", F.lit(False)))))).alias("mol_cols"),
        (F.lit(today) if today else F.current_date().cast("string")).alias("downloaded"),
    )


RAW_COLUMNS = [c.split()[0] for c in RAW.split(", ")]
