"""Reports. Each format is first a projection that Spark can write at any size; a single document is a header, ordered rows and a footer.

``render`` gives a document as a string, for a terminal. ``write_document`` has the tasks render the rows in order into part files,
which the file system's streams join behind the header, so that the driver holds no findings, however many there are.
"""

from __future__ import annotations

import csv
import io
import json
import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from xml.etree import ElementTree as Xml

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternscan.operators.findings import order_keys, rule_summary
from lanternscan.schema import NAMES, ORDER, finding
from lanternscan.sinks import templates
from lanternscan.sources.files import shared_folder

TOOL = "lanternscan"
VERSION = "1.0.0"
OPTIONAL = {"commit", "author", "email", "date", "message", "tags", "link"}

# Header of the comma-separated report, and the schema address of the SARIF format.
CSV_COLUMNS = {
    "RuleID": "rule_id", "Description": "description", "File": "file", "StartLine": "start_line", "Secret": "secret",
    "Commit": "commit", "Author": "author", "Fingerprint": "fingerprint",
}
#: Characters that XML cannot hold.
NOT_XML = re.compile("[^\t\n\r\x20-\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]")
SARIF_SCHEMA = "https://json.schemastore.org/sarif-2.1.0.json"


def csv_rows(findings: DataFrame) -> DataFrame:
    return findings.select(*(F.col(c).cast("string").alias(name) for name, c in CSV_COLUMNS.items()))


def json_rows(findings: DataFrame) -> DataFrame:
    """One JSON object per finding; optional fields that are empty are left out."""
    cols = [F.when(F.length(F.col(c).cast("string")) > 0, F.col(c)).alias(c) if c in OPTIONAL and c != "tags" else F.col(c) for c in NAMES]
    return finding(findings).select(F.to_json(F.struct(*cols), {"ignoreNullFields": "true"}).alias("value"))


def junit_rows(findings: DataFrame) -> DataFrame:
    """A test case per finding: suite, name, message and text."""
    text = F.format_string("Secret detected in %s at line %d: %s", "file", "start_line", "secret")
    return findings.select(
        F.col("rule_id").alias("suite"), F.concat_ws(":", "file", F.col("start_line").cast("string")).alias("name"),
        F.col("description").alias("message"), text.alias("text"), *(c for c in ORDER if c in findings.columns),
    )


def sarif_rules(findings: DataFrame) -> DataFrame:
    """Distinct rules with their first description, in order of appearance."""
    return rule_summary(findings).select("rule_id", "description", "first")


def sarif_results(findings: DataFrame) -> DataFrame:
    region = F.struct(
        F.col("start_line").alias("startLine"), F.col("start_column").alias("startColumn"),
        F.col("end_line").alias("endLine"), F.col("end_column").alias("endColumn"),
    )
    place = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    return findings.select(
        F.col("rule_id").alias("ruleId"), F.struct(F.col("description").alias("text")).alias("message"),
        F.array(place).alias("locations"), F.create_map(F.lit("fingerprint/v1"), "fingerprint").alias("fingerprints"),
    )


def _ordered(findings: DataFrame) -> DataFrame:
    return findings.orderBy(*order_keys(findings)) if order_keys(findings) else findings


@dataclass
class Document:
    """``header``, the strings of ``rows`` (value) with ``separator`` between them, and ``footer``; ``empty`` where there is no row."""

    header: str
    rows: DataFrame
    separator: str
    footer: str
    empty: str


def _mapped(rows: DataFrame, build: Callable[[], Callable[[dict], str]]) -> DataFrame:
    """A string per row, in the rows' order, made in the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = build()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([make(r) for r in batch.to_pylist()], type=pa.string())], names=["value"])

    return rows.mapInArrow(run, "value string")


def _indented(depth: int) -> Callable[[], Callable[[dict], str]]:
    pad = " " * depth

    def build():
        return lambda r: pad + json.dumps(json.loads(r["value"]), indent=2, ensure_ascii=False).replace("\n", "\n" + pad)

    return build


def json_document(findings: DataFrame) -> Document:
    """An indented array; ``null`` when there is nothing."""
    return Document("[\n", _mapped(json_rows(_ordered(findings)), _indented(2)), ",\n", "\n]\n", "null\n")


def csv_document(findings: DataFrame) -> Document:
    def line(cells: Iterable) -> str:
        out = io.StringIO()
        csv.writer(out, lineterminator="").writerow(cells)
        return out.getvalue()

    head = line(CSV_COLUMNS)
    return Document(head + "\n", _mapped(csv_rows(_ordered(findings)), lambda: lambda r: line(r.values())), "\n", "\n", head + "\n")


def junit_document(findings: DataFrame) -> Document:
    """A suite per rule, in order of appearance. A suite's tags are rows of their own, before and behind its cases."""
    keys = [k.alias(f"k{n}") for n, k in enumerate(order_keys(findings))]
    suites = rule_summary(findings).select(F.col("rule_id").alias("suite"), F.col("findings"), F.struct("first", "rule_id").alias("at"))
    none = F.lit(None).cast("string")
    order = F.struct(*keys) if keys else F.struct(F.lit(0).alias("k0"))
    text = F.format_string("Secret detected in %s at line %d: %s", "file", "start_line", "secret")
    cases = findings.select(F.col("rule_id").alias("suite"), F.concat_ws(":", "file", F.col("start_line").cast("string")).alias("name"), F.coalesce("description", F.lit("")).alias("message"), text.alias("text"), order.alias("order"))
    cases = cases.join(F.broadcast(suites.select("suite", "at")), "suite").select("at", F.lit(1).alias("kind"), "order", "suite", "name", "message", "text", F.lit(None).cast("long").alias("n"))
    kind = cases.schema["order"].dataType
    tags = [suites.select("at", F.lit(k).alias("kind"), F.lit(None).cast(kind).alias("order"), "suite", none.alias("name"), none.alias("message"), none.alias("text"), F.col("findings").alias("n")) for k in (0, 2)]
    rows = tags[0].unionByName(cases).unionByName(tags[1]).orderBy("at", "kind", "order").select("kind", "suite", "name", "message", "text", "n")

    def build():
        def make(r: dict) -> str:
            r = {k: NOT_XML.sub("\ufffd", v) if isinstance(v, str) else v for k, v in r.items()}
            if r["kind"] == 2:
                return "  </testsuite>"
            if r["kind"] == 0:
                made = Xml.Element("testsuite", name=r["suite"], tests=str(r["n"]), failures=str(r["n"]))
                return "  " + Xml.tostring(made, encoding="unicode").replace(" />", ">")
            case = Xml.Element("testcase", name=r["name"], classname=r["suite"])
            Xml.SubElement(case, "failure", message=r["message"], type=r["suite"]).text = r["text"]
            Xml.indent(case, level=2)
            return "    " + Xml.tostring(case, encoding="unicode")

        return make

    top = '<?xml version="1.0" encoding="UTF-8"?>\n'
    return Document(f"{top}<testsuites>\n", _mapped(rows, build), "\n", "\n</testsuites>\n", f"{top}<testsuites />\n")


def sarif_document(findings: DataFrame) -> Document:
    """The rules, of which there are as many as a rule set has, stand in the header."""
    rules = [{"id": r.rule_id, "shortDescription": {"text": r.description}} for r in sarif_rules(findings).orderBy("first").collect()]
    driver = {"name": TOOL, "semanticVersion": VERSION, "rules": rules}
    whole = lambda results: json.dumps({"$schema": SARIF_SCHEMA, "version": "2.1.0", "runs": [{"tool": {"driver": driver}, "results": results}]}, indent=2, ensure_ascii=False) + "\n"
    mark = '"\\u0000results"'
    head, foot = whole(["\0results"]).split(mark)
    rows = sarif_results(_ordered(findings)).select(F.to_json(F.struct("ruleId", "message", "locations", "fingerprints")).alias("value"))
    pad = len(head) - len(head.rstrip(" "))
    return Document(head.rstrip(" "), _mapped(rows, _indented(pad)), ",\n", foot, whole([]))


def template_document(findings: DataFrame, template: str) -> Document:
    """A text for the findings: see ``templates``. What a template has of ranges over all findings is rendered in the tasks; a
    template of texts and fields only is repeated for each finding."""
    tree = templates.parse(template)
    loops = [n for n in tree if templates.lists_findings(n)]
    if not loops and all(n.kind == "text" or re.fullmatch(r"\.\w+", n.text) for n in tree):
        tree = loops = [templates.Node("range", ".", tree)]
    if len(loops) > 1:
        raise templates.TemplateError("a second range over the findings")
    dot, names = templates.Findings(lambda: findings.count()), {}
    names["$"] = dot
    if not loops:
        return Document(templates.render(tree, dot, names), findings.select(F.lit("").alias("value")).limit(0), "", "", templates.render(tree, dot, names))
    at = next(k for k, n in enumerate(tree) if n is loops[0])
    bound, _ = templates.loop_of(loops[0])
    if len(bound) == 2:
        raise templates.TemplateError("findings are not numbered in a range")
    head, tail = templates.render(tree[:at], dot, names), templates.render(tree[at + 1 :], dot, names)
    body, known = loops[0].body, {k: v for k, v in names.items() if k != "$"}
    rows = _mapped(finding(_ordered(findings)), lambda: lambda r: templates.render(body, r, known | {n: r for n in bound}))
    return Document(head, rows, "", tail, head + templates.render(loops[0].other, dot, dict(names)) + tail)


DOCUMENTS = {"json": json_document, "csv": csv_document, "junit": junit_document, "sarif": sarif_document}


def document(findings: DataFrame, form: str, template: str = "") -> Document:
    """The document of a format; unknown formats give JSON."""
    return template_document(findings, template) if form == "template" else DOCUMENTS.get(form, json_document)(findings)


def render(findings: DataFrame, form: str, template: str = "") -> str:
    """A whole report as a string. Rows stream to the driver partition by partition."""
    d = document(findings, form, template)
    rows = [r.value for r in d.rows.toLocalIterator()]
    return d.header + d.separator.join(rows) + d.footer if rows else d.empty


def write_document(findings: DataFrame, form: str, path: str, template: str = "") -> None:
    """A whole report as one file at a path of any file system. Tasks write the rows; the driver only joins streams."""
    d = document(findings, form, template)
    spark = findings.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    file = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    target = file(path)
    parts = f"{shared_folder(spark)}/report-{uuid.uuid4().hex}"
    # the writer ends each row with a separator; where a format has none, with a mark that no text holds, which is taken out again
    end = d.separator or f"\x1e{uuid.uuid4().hex}\n"
    d.rows.write.option("lineSep", end).text(parts)
    source = file(parts)
    files = source.getFileSystem(conf)
    found = sorted((str(f.getPath().getName()), f.getLen()) for f in files.listStatus(source) if str(f.getPath().getName()).startswith("part-") and f.getLen())
    out = target.getFileSystem(conf).create(target, True)
    try:
        put = lambda text: out.write(bytearray(text.encode()))
        put(d.header if found else d.empty)
        for k, (name, size) in enumerate(found):
            part = files.open(file(f"{parts}/{name}"))
            if d.separator:
                keep = size - (len(end.encode()) if k == len(found) - 1 else 0)
                jvm.org.apache.commons.io.IOUtils.copyLarge(part, out, 0, keep)
            else:  # rows without anything between them, in blocks
                mark, held = end.encode(), b""
                while block := bytes(part.readNBytes(1 << 20)):
                    held = (held + block).replace(mark, b"")
                    out.write(bytearray(held[: -len(mark)]))
                    held = held[-len(mark) :]
                out.write(bytearray(held))
            part.close()
        if found:
            put(d.footer)
    finally:
        out.close()
        files.delete(source, True)


def to_json(findings: DataFrame) -> str:
    return render(findings, "json")


def to_csv(findings: DataFrame) -> str:
    return render(findings, "csv")


def to_junit(findings: DataFrame) -> str:
    return render(findings, "junit")


def to_sarif(findings: DataFrame) -> str:
    return render(findings, "sarif")


def to_template(findings: DataFrame, template: str) -> str:
    return render(findings, "template", template)


def write_rows(findings: DataFrame, form: str, path: str) -> None:
    """The distributed form of a report: part files of JSON lines or comma-separated rows."""
    if form == "csv":
        csv_rows(findings).write.option("header", True).csv(path)
    else:
        json_rows(findings).write.text(path)


def formats() -> Iterable[str]:
    return (*DOCUMENTS, "template")
