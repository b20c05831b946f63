"""Files beside the tables: policies, tasks, ground truth in pages, personas by seed; and where results go."""

from __future__ import annotations

import json
from collections.abc import Callable
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork import schema
from siftwork.operators import shape

POLICY = (
    "policy struct<name:string,unexplained_prior:double,screenshot:struct<enabled:boolean>,thresholds:struct<tokenize:double,mask:double,drop:double>,tiers:map<string,string>,fail_mode:string,require_confirmation:array<string>,max_elements:int,"
    "gateway_origin:string,max_payload_bytes:bigint>, fusion struct<source_weights:map<string,double>,min_coverage:double>"
)


def policies(spark: SparkSession, path: str) -> DataFrame:
    """(file, policy, fusion, faults array<string>) of a folder of JSON policies. A file that isn't JSON of these types fails the read; what is out of range is a fault."""
    rows = spark.read.schema(POLICY).option("multiLine", True).option("mode", "FAILFAST").json(path).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), "policy", "fusion")
    share = lambda c, name: F.when(~F.coalesce(F.col(c).between(0, 1), F.lit(False)), name)
    t = "policy.thresholds"
    faults = F.array(
        F.when(~F.coalesce(F.col("policy.name").isin(*schema.PROFILES), F.lit(False)), "name"), share("policy.unexplained_prior", "unexplained_prior"), share("fusion.min_coverage", "min_coverage"),
        F.when(~F.coalesce((F.col(f"{t}.tokenize") <= F.col(f"{t}.mask")) & (F.col(f"{t}.mask") <= F.col(f"{t}.drop")), F.lit(False)), "thresholds"),
        F.when(F.size(F.array_except(F.array(*[F.lit(f"T{k}") for k in range(1, 6)]), F.map_keys("policy.tiers"))) > 0, "tiers"), F.when(~F.coalesce(F.col("policy.fail_mode") == "CLOSED", F.lit(False)), "fail_mode"),
        F.when(F.exists(F.coalesce(F.map_values("fusion.source_weights"), F.array(F.lit(-1.0))), lambda w: ~w.between(0, 1)), "source_weights"),
    )
    return rows.withColumn("faults", F.filter(faults, lambda f: f.isNotNull()))


def tasks(spark: SparkSession, path: str, only: list[str] | None = None) -> DataFrame:
    """(id, fields map<string, string>) of a folder of YAML task files, by id: the scalars at the top of each; nested parts stay out."""
    text = spark.read.option("pathGlobFilter", "*.y*ml").text(path, wholetext=True)
    lines = F.filter(F.split("value", r"\r?\n"), lambda x: x.rlike(r"^[A-Za-z_][A-Za-z0-9_]*:\s*[^\s#]"))
    pair = lambda x: F.struct(F.regexp_extract(x, "^([A-Za-z0-9_]+):", 1), F.regexp_replace(F.trim(F.regexp_extract(x, r"^[A-Za-z0-9_]+:\s*(.*)$", 1)), "^([\"'])(.*)\\1$", "$2"))
    rows = text.select(F.map_from_entries(F.transform(lines, pair)).alias("fields")).select(F.try_element_at("fields", F.lit("id")).alias("id"), "fields")
    rows = rows.where(F.col("id").isin(*only)) if only else rows
    return rows.orderBy("id")


PII = {"type": "string", "tier": "int", "value_id": "string", "decoy": "boolean", "value": "string"}
REGION = {"type": "string", "value_id": "string", "x": "double", "y": "double", "w": "double", "h": "double"}


class _Truth(HTMLParser):
    def __init__(self, prefix: str):
        super().__init__(convert_charrefs=True)
        self.prefix, self.open, self.found, self.regions = prefix, [], [], []

    def handle_starttag(self, tag, attrs):
        at = dict(attrs)
        get = lambda k: at.get(f"{self.prefix}-{k}")
        for region in self._regions(get("regions")):
            self.regions.append({"type": region.get("pii"), "value_id": region.get("value_id"), **{k: float(region.get(k) or 0) for k in "xywh"}})
        self.open.append((tag, {"type": get("pii"), "tier": int(get("tier") or 0), "value_id": get("value-id"), "decoy": get("decoy") == "true", "text": ""} if get("pii") not in (None, "NONE") else None))
        if tag in ("input", "img", "br", "hr", "meta", "link"):
            self.handle_endtag(tag)

    @staticmethod
    def _regions(text: str | None) -> list[dict]:
        try:
            return [r for r in json.loads(text or "[]") if isinstance(r, dict)]
        except ValueError:
            return []

    def handle_data(self, data):
        for _, mine in self.open:
            if mine is not None:
                mine["text"] += data

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                self.found += [m for _, m in self.open[i:] if m is not None]
                del self.open[i:]
                break


def told_by(html: str, prefix: str) -> tuple[list[dict], list[dict]]:
    """What one instrumented page says that it shows: values with text, and regions."""
    t = _Truth(prefix)
    t.feed(html)
    t.close()
    return [{**{k: v for k, v in m.items() if k != "text"}, "value": m["text"].strip()} for m in t.found if m["text"].strip()], t.regions


def truth(pages: DataFrame, prefix: str = "data-truth", key: str = "page_id", html_col: str = "html") -> DataFrame:
    """(key, pii array<struct<type, tier, value_id, decoy, value>>, regions array<struct<type, value_id, x, y, w, h>>): what instrumented pages say they show, in attributes of a prefix and
    regions as JSON. Elements without text and regions that can't be read are left out."""
    pii = pa.list_(pa.struct([("type", pa.string()), ("tier", pa.int32()), ("value_id", pa.string()), ("decoy", pa.bool_()), ("value", pa.string())]))
    region = pa.list_(pa.struct([("type", pa.string()), ("value_id", pa.string()), *[(k, pa.float64()) for k in "xywh"]]))

    def run(batches):
        for batch in batches:
            found = [told_by(html or "", prefix) for html in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pii), pa.array([f[1] for f in found], region)], names=[key, "pii", "regions"])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, html_col).mapInArrow(run, f"{key} {kind}, pii array<struct<type:string,tier:int,value_id:string,decoy:boolean,value:string>>, regions array<struct<type:string,value_id:string,x:double,y:double,w:double,h:double>>")


_MASK = 0xFFFFFFFF


def _times(a: Column, b: Column) -> Column:
    """The low 32 bits of a product of two numbers of 32 bits."""
    return (a.bitwiseAND(F.lit(0xFFFF)) * b + F.shiftleft((F.shiftrightunsigned(a, 16) * b).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(_MASK))


def draw(seed: Column, n) -> Column:
    """The nth number, from 0, in [0, 1) of the counter-based generator mulberry32: any draw can be made without those before it."""
    let = lambda v, body: F.transform(F.array(v), body)[0]
    low = lambda v: v.bitwiseAND(F.lit(_MASK))
    state = low(seed.cast("long") + (F.lit(n) if isinstance(n, int) else n).cast("long").__add__(1) * F.lit(0x9E3779B9))
    first = lambda t: _times(t.bitwiseXOR(F.shiftrightunsigned(t, 15)), t.bitwiseOR(F.lit(1)))
    second = lambda r: low(r.bitwiseXOR(low(r + _times(r.bitwiseXOR(F.shiftrightunsigned(r, 7)), r.bitwiseOR(F.lit(61))))))
    last = lambda r: r.bitwiseXOR(F.shiftrightunsigned(r, 14)) / F.lit(4294967296.0)
    return let(state, lambda t: let(first(t), lambda r: let(second(r), last)))


def chosen(seed: Column, n: int, names) -> Column:
    """One of names by the nth draw."""
    return F.get(F.array(*map(F.lit, names)), F.floor(draw(seed, n) * len(names)).cast("int"))


# ---- sinks
def append(rows: DataFrame, path: str) -> None:
    """Audit rows at the end of a table; what is there is never rewritten."""
    rows.write.mode("append").parquet(path)


def report(rows: DataFrame, path: str) -> None:
    """A result of a bounded number of rows as one file of JSON lines."""
    rows.coalesce(1).write.mode("overwrite").json(path)


def exported_schema(rows: DataFrame, name: str = "rows") -> str:
    """JSON Schema of rows as they are written as JSON; shape.export() writes such documents."""
    return shape.document(name, shape.of_rows(rows.schema))


def send(stream: DataFrame, post: Callable[[list[dict]], None], checkpoint: str, batch: int = 100):
    """Rows of a stream handed to post, task by task in lists of `batch`: the only way out. A failed post fails the batch, which is then sent again."""

    def go(rows: DataFrame, _: int) -> None:
        def each(part):
            out = []
            for r in part:
                out.append(r.asDict(recursive=True))
                if len(out) == batch:
                    post(out)
                    out = []
            if out:
                post(out)

        rows.foreachPartition(each)

    return stream.writeStream.foreachBatch(go).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
