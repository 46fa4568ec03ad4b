"""Nested page records as flat tables that keep the links of child to parent (problem 2).

One depth-first visit of each record emits, for every page, revision, contributor and text that it meets, one row of
table tag, primary key, parent key and payload. The rows are written once, partitioned by tag; each flat table reads
only its own partition and gives the payload its schema.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelathe.functions.jsontext import loads
from pagelathe.session import scratch
from pagelathe.sources.dumps import PAGE

TAGGED = "tag string, pk string, parent string, page_id bigint, rev_id bigint, payload string"
#: Schemas of the payloads by tag.
PAYLOADS = {
    "page": "title string, ns bigint",
    "revision": "parentid bigint, timestamp string, format string, comment string",
    "contributor": "username string, ip string, user_id bigint",
    "text": "role string, text string",
    "refused": "body string",
}
#: Marks that may stand around a record without being part of it: control and format characters, byte order marks.
INVISIBLE = "".join(chr(c) for low, high in ((0, 0x20), (0x7F, 0xA1), (0xAD, 0xAD), (0x61C, 0x61C), (0x180E, 0x180E), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0xFEFF, 0xFEFF), (0xFFF9, 0xFFFB)) for c in range(low, high + 1) if c != 0xA1)


def bare(s: str) -> str:
    """Without outer white space and invisible marks."""
    while True:
        t = s.strip().strip(INVISIBLE)
        if t == s:
            return t
        s = t


def sound(s: str) -> str:
    """With a question mark for each half of a surrogate pair, which has no UTF-8."""
    return s.encode("utf-8", "replace").decode()


def scalar(v) -> str | None:
    """The text of a member in any shape: plain, ``#text`` of an object, or the parts of a list in order."""
    parts, stack = [], [v]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            parts.append(x)
        elif isinstance(x, dict):
            stack.append(x.get("#text"))
        elif isinstance(x, list):
            stack += reversed(x)
        elif isinstance(x, (int, float)) and not isinstance(x, bool):
            parts.append(str(x))
    return "".join(parts) if parts else None


def whole(v) -> int | None:
    """The whole number of a member that is a number or the text of one; none beyond 64 bits."""
    t = scalar(v)
    try:
        n = int(t.strip()) if t is not None else None
    except ValueError:
        return None
    return n if n is not None and -(2**63) <= n < 2**63 else None


#: Members of which a revision has one at least, if it isn't merely wrapped around others.
OWN = ("id", "text", "timestamp", "slots", "contributor", "parentid")


def each(v, inner: str) -> Iterator:
    """Members of a list, or the one object in its place; ``{inner: ...}`` is opened. What is no object is left out."""
    stack = [v]
    while stack:
        x = stack.pop()
        if isinstance(x, list):
            stack += reversed(x)
        elif isinstance(x, dict):
            wrapped = isinstance(x.get(inner), (list, dict))
            if wrapped:
                stack.append(x[inner])
            if not wrapped or (inner == "revision" and any(k in x for k in OWN)):
                yield x


def roots(v) -> Iterator[dict]:
    """Page objects of a record, depth first, however they are wrapped."""
    stack = [v]
    while stack:
        x = stack.pop()
        if isinstance(x, list):
            stack += reversed(x)
        elif isinstance(x, dict):
            if any(k in x for k in ("revision", "title", "ns")):
                yield x
            else:
                stack += [x[k] for k in reversed(list(x)) if isinstance(x[k], (dict, list))]


def complete(body: str | None):
    """The value of a body, None if it isn't complete JSON."""
    try:
        return loads(bare(body or ""))
    except ValueError:
        return None


def page_objects(body: str | None) -> list[dict]:
    """Page objects of one record; none if it isn't complete JSON."""
    return list(roots(complete(body)))


def people(rev: dict) -> list[dict]:
    """A revision's contributors as objects, whatever their shape; one at least, the one that counts first."""
    who = rev.get("contributor")
    found = [x if isinstance(x, dict) else {"username": x} for x in (who if isinstance(who, list) else [who])]
    return found or [{}]


def pack(**x) -> str:
    return sound(json.dumps({k: v for k, v in x.items() if v is not None}, ensure_ascii=False))


def named(prefix: str, number: int | None, content: Callable[[], list]) -> str:
    """A key: the number, or where it is missing a hash of the content, so that only what is delivered again is the same."""
    return f"{prefix}{number}" if number is not None else f"{prefix}#{hashlib.md5(json.dumps(content()).encode()).hexdigest()}"  # noqa: S324


def revision_rows(rev: dict) -> list[tuple[str, str, str]]:
    """Tag, end of the key and payload of a revision, its contributor and its texts."""
    rows = [
        ("revision", "", pack(parentid=whole(rev.get("parentid")), timestamp=scalar(rev.get("timestamp")), format=scalar(rev.get("format")), comment=scalar(rev.get("comment")))),
    ]
    for k, who in enumerate(people(rev)):
        name, ip = scalar(who.get("username")), scalar(who.get("ip"))
        rows.append(("contributor", f"/c{k or ''}", pack(username=name and name.strip(), ip=ip and ip.strip(), user_id=whole(who.get("id")))))
    own = scalar(rev.get("text"))
    if own and own.strip():
        rows.append(("text", "/t:main", pack(role="main", text=own)))
    for slot in each(rev.get("slots"), "slot"):
        text, role = scalar(slot.get("text")), sound(scalar(slot.get("role")) or "").strip()
        if text and text.strip():
            rows.append(("text", f"/t:{role}", pack(role=role, text=text)))
    return rows


def visit(body: str | None) -> Iterator[tuple]:
    """Tagged rows of one record; of a body that has something but isn't complete JSON, only the body itself."""
    record = complete(body)
    if record is None and bare(body) not in ("", "null"):
        yield "refused", hashlib.md5(sound(body).encode()).hexdigest(), None, None, None, pack(body=body)  # noqa: S324
    for page in roots(record):
        page_id, title = whole(page.get("id")), scalar(page.get("title"))
        payload = pack(title=title, ns=whole(page.get("ns")))
        revs = ((whole(rev.get("id")), revision_rows(rev)) for rev in each(page.get("revision"), "revision"))
        if page_id is None and title is None:
            revs = list(revs)
        page_key = named("p", page_id, lambda: [payload] if title is not None else [payload, revs])  # noqa: B023
        yield "page", page_key, None, page_id, None, payload
        for rev_id, rows in revs:
            key = named(f"{page_key}/r", rev_id, lambda: [page_key, sorted(set(rows))])  # noqa: B023
            for tag, end, payload in rows:
                yield tag, key + end, page_key if tag == "revision" else key, page_id, rev_id, payload


def page_records(raw: DataFrame) -> DataFrame:
    """``title, revision`` (as ``dumps.PAGE``) of every page in ``raw.body``, wrapped and shaped in any way, repeats included.

    Revisions are in document order. A page without a title has a null one, a page without revisions an empty list.
    """
    revision = pa.struct([("timestamp", pa.string()), ("contributor", pa.struct([("username", pa.string())])), ("format", pa.string()), ("text", pa.string())])
    schema = pa.schema([("title", pa.string()), ("revision", pa.list_(revision))])

    def text(v) -> str | None:
        t = scalar(v)
        return None if t is None else sound(t)

    def row(page: dict) -> dict:
        revs = each(page.get("revision"), "revision")
        return {"title": text(page.get("title")), "revision": [{"timestamp": text(r.get("timestamp")), "contributor": {"username": text(people(r)[0].get("username"))}, "format": text(r.get("format")), "text": text(r.get("text"))} for r in revs]}

    def run(batches):
        for batch in batches:
            rows, size = [], 0
            for body in batch.column(0).to_pylist():
                rows += map(row, page_objects(body))
                size += len(body)
                if size > 8_000_000:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return raw.select("body").where("body is not null").mapInArrow(run, PAGE)


def tagged_rows(raw: DataFrame) -> DataFrame:
    """One pass over ``raw.body``: the tagged rows of all records, repeats included."""
    schema = pa.schema([("tag", pa.string()), ("pk", pa.string()), ("parent", pa.string()), ("page_id", pa.int64()), ("rev_id", pa.int64()), ("payload", pa.string())])

    def run(batches):
        rows, size = [], 0
        for batch in batches:
            for body in batch.column(0):
                for row in visit(body.as_py()):
                    rows.append(row)
                    size += len(row[5])
                    if size > 8_000_000 or len(rows) >= 20_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return raw.select("body").where("body is not null").mapInArrow(run, TAGGED)


class FlatTables:
    """The flat tables of one written set of tagged rows."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _rows(self, tag: str) -> DataFrame:
        rows = self.spark.read.schema(TAGGED).parquet(self.path).where(F.col("tag") == tag)
        return rows.select("pk", "parent", "page_id", "rev_id", F.from_json("payload", PAYLOADS[tag]).alias("x")).select("pk", "parent", "page_id", "rev_id", "x.*")

    def _one(self, tag: str) -> DataFrame:
        """Each primary key once: of rows delivered again the one with the most that sorts last."""
        rows = self._rows(tag)
        values = [c for c in rows.columns if c not in ("pk", "parent", "page_id", "rev_id")]
        packed = F.struct(sum((F.col(c).isNotNull().cast("int") for c in values), F.lit(0)).alias("filled"), *values)
        kept = rows.groupBy("pk", "parent", "page_id", "rev_id").agg(F.max(packed).alias("x"))
        return kept.select("pk", "parent", "page_id", "rev_id", *[F.col(f"x.{c}").alias(c) for c in values])

    def pages(self) -> DataFrame:
        """``pk, page_id, title, ns``"""
        return self._one("page").select("pk", "page_id", "title", "ns")

    def revisions(self) -> DataFrame:
        """``pk, parent, page_id, rev_id, parentid, timestamp, format, comment``"""
        return self._one("revision")

    def contributors(self) -> DataFrame:
        """``pk, parent, page_id, rev_id, username, ip, user_id, contributor``; the last is '' where there is neither name nor ip.

        A revision has one at least; of several the first, whose key ends in ``/c``, is its contributor elsewhere."""
        name = F.coalesce(F.nullif("username", F.lit("")), F.nullif("ip", F.lit("")), F.lit(""))
        return self._one("contributor").withColumn("contributor", name)

    def refused(self) -> DataFrame:
        """``body, n``: what isn't complete JSON, and how often it came."""
        return self._rows("refused").groupBy("body").agg(F.count(F.lit(1)).alias("n"))

    def texts(self) -> DataFrame:
        """``pk, parent, page_id, rev_id, role, text``"""
        return self._one("text")

    def found(self) -> DataFrame:
        """``page_id, rev_id, contributor, role``: one row per text with the contributor of its revision."""
        roles = self.spark.read.schema(TAGGED).parquet(self.path).where("tag = 'text'").select("parent", "page_id", "rev_id", F.get_json_object("payload", "$.role").alias("role")).distinct()
        first = self.contributors().where(F.col("pk").endswith("/c")).select("parent", "contributor")
        return roles.join(first, "parent", "left").select("page_id", "rev_id", F.coalesce("contributor", F.lit("")).alias("contributor"), "role")


def flatten_pages(raw: DataFrame) -> FlatTables:
    """Write the tagged rows of ``raw.body`` to the shared folder, partitioned by tag, and give the flat tables.

    Null, empty and non-object bodies give no rows; damaged ones (NaN is no JSON) go to ``refused``. Bodies may be nested to any depth. Members may be missing or come in any shape (text, object
    with ``#text``, list). A page without an id has a null id and a key by its title and namespace (without a title, by all it holds), a
    revision without one a key by its page's key and all it holds. Texts are kept whole.
    """
    path = scratch(raw.sparkSession, "tagged")
    tagged_rows(raw).write.partitionBy("tag").option("compression", "zstd").parquet(path)
    return FlatTables(raw.sparkSession, path)
