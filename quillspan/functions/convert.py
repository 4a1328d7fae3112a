"""The conversion kernel on columns: one Python call a document, whatever is asked of it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import pandas_udf

from quillspan.operators.dom import CDATA, Node, events, parse
from quillspan.operators.markdown import to_markdown
from quillspan.operators.options import Options, minimal
from quillspan.operators.plain import extract, to_safe_html, to_text
from quillspan.operators.prepare import Plugin, apply_plugins, frontmatter_block, head_metadata, prepare
from quillspan.operators.splitter import Split, split_markdown
from quillspan.plans.tables import spread

_ELEMENT = "struct<selector:string,tag:string,text:string,attributes:map<string,string>>"
_CHUNK = "struct<chunk_no:int,content:string,headers:map<string,string>,code:string,line_from:int,line_to:int>"
OUTPUTS = {
    "markdown": "string", "text": "string", "safe_html": "string", "metadata": "map<string,string>",
    "extracted": f"array<{_ELEMENT}>", "chunks": f"array<{_CHUNK}>", "n_links": "int", "truncated": "boolean",
}
_ARROW_ELEMENT = pa.struct([("selector", pa.string()), ("tag", pa.string()), ("text", pa.string()), ("attributes", pa.map_(pa.string(), pa.string()))])
_ARROW_CHUNK = pa.struct([("chunk_no", pa.int32()), ("content", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("code", pa.string()), ("line_from", pa.int32()), ("line_to", pa.int32())])
_ARROW = {
    "markdown": pa.string(), "text": pa.string(), "safe_html": pa.string(), "metadata": pa.map_(pa.string(), pa.string()),
    "extracted": pa.list_(_ARROW_ELEMENT), "chunks": pa.list_(_ARROW_CHUNK), "n_links": pa.int32(), "truncated": pa.bool_(),
}


Hook = Callable[[Node], None] | Plugin


def convert_one(
    html: str | None, outputs: tuple[str, ...], o: Options, selectors: tuple[str, ...] = (), split: Split = Split(), hooks: tuple[Hook, ...] = ()
) -> tuple:
    """What is asked of one document; the tree is built once and rendered only where a rendering is asked for.

    Hooks are functions of the tree's root that may change it, called in order before anything is taken from it,
    and plugins (``prepare.Plugin``), which run together after them.
    """
    if html is None:
        return (None,) * len(outputs)
    cut = bool(o.max_text) and len(html) > o.max_text
    if cut:
        html = html[: html.rfind(">", 0, o.max_text) + 1]
    if o.overrides:
        void = frozenset(t for t, x in o.overrides.items() if x.self_closing)
        root = parse(html, CDATA in o.overrides, void)
    else:
        root = parse(html)
    for hook in hooks:
        if not isinstance(hook, Plugin):
            hook(root)
    if plugins := tuple(h for h in hooks if isinstance(h, Plugin)):
        apply_plugins(root, plugins)
    got: dict[str, object] = {"truncated": cut}
    if "metadata" in outputs or o.frontmatter:
        got["metadata"] = head_metadata(root, o.meta_fields, o.additional_fields)
    if "extracted" in outputs:
        got["extracted"] = [
            {"selector": s, "tag": t, "text": x, "attributes": list(a.items())} for s, t, x, a in extract(root, selectors)
        ]
    if "n_links" in outputs:
        got["n_links"] = sum(n.tag == "a" and "href" in n.attrs for n in root.walk())
    if {"markdown", "text", "safe_html", "chunks"} & set(outputs):
        prepare(root, o)
        if "text" in outputs:
            got["text"] = to_text(root, o)
        if "safe_html" in outputs:
            got["safe_html"] = to_safe_html(root, o)
        if {"markdown", "chunks"} & set(outputs):
            md = to_markdown(root, o)
            if o.frontmatter and (block := frontmatter_block(got["metadata"], o.additional_fields)):
                md = f"{block}\n\n{md}" if md else block
            got["markdown"] = md
            if "chunks" in outputs:
                got["chunks"] = [
                    {"chunk_no": n, "content": c, "headers": list(h.items()), "code": code, "line_from": a, "line_to": b}
                    for n, c, h, code, a, b in split_markdown(md, split)
                ]
    if "metadata" in got:
        got["metadata"] = list(got["metadata"].items())
    return tuple(got.get(x) for x in outputs)


def convert(
    df: DataFrame, keep: list[str], html: str = "html", outputs: tuple[str, ...] = ("markdown",),
    o: Options = Options(), selectors: tuple[str, ...] = (), split: Split = Split(), hooks: tuple[Hook, ...] = (),
) -> DataFrame:
    """The columns ``keep`` and those of ``outputs``, from one pass of the kernel over each document."""
    if bad := set(outputs) - set(OUTPUTS):
        raise ValueError(f"unknown outputs {sorted(bad)}; there are {', '.join(OUTPUTS)}")
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema)
    schema = ", ".join([kept, *(f"{x} {OUTPUTS[x]}" for x in outputs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [convert_one(x, outputs, o, selectors, split, hooks) for x in batch.column(batch.num_columns - 1).to_pylist()]
            made = [pa.array([r[k] for r in rows], _ARROW[x]) for k, x in enumerate(outputs)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], [*batch.schema.names[:-1], *outputs])

    return spread(df.select(*keep, html)).mapInArrow(run, schema)


def html_events(df: DataFrame, key: str, html: str = "html") -> DataFrame:
    """The event relation ``(key, seq, ev, node_id, parent_id, tag, attrs, text)``; ev: 0 enter, 1 exit, 2 text."""
    kind = df.schema[key].dataType.simpleString()
    names = [key, "seq", "ev", "node_id", "parent_id", "tag", "attrs", "text"]
    kinds = [None, pa.int32(), pa.int8(), pa.int32(), pa.int32(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = [(k, *e[:5], None if e[5] is None else list(e[5].items()), e[6]) for e in events(x or "")]
                if rows:
                    columns = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t or batch.schema.field(0).type) for c, t in zip(columns, kinds, strict=True)], names
                    )

    return spread(df.select(key, html)).mapInArrow(
        run, f"`{key}` {kind}, seq int, ev tinyint, node_id int, parent_id int, tag string, attrs map<string,string>, text string"
    )


def split_texts(df: DataFrame, keep: list[str], text: str, split: Split = Split()) -> DataFrame:
    """``keep`` and the chunks of a column of Markdown, one row a chunk."""
    from pyspark.sql import functions as F

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [
                [
                    {"chunk_no": n, "content": c, "headers": list(h.items()), "code": code, "line_from": a, "line_to": b}
                    for n, c, h, code, a, b in split_markdown(x, split)
                ]
                for x in batch.column(batch.num_columns - 1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(made, pa.list_(_ARROW_CHUNK))], [*batch.schema.names[:-1], "chunks"])

    out = spread(df.select(*keep, text)).mapInArrow(run, f"{kept}, chunks array<{_CHUNK}>")
    return out.select(*keep, F.explode("chunks").alias("c")).select(*keep, "c.*")


def register(spark: SparkSession) -> None:
    """``html_to_markdown``, ``html_to_markdown_minimal``, ``html_to_text`` and ``html_to_safe_html`` for SQL."""
    import pandas as pd

    kinds = {
        "html_to_markdown": ("markdown", Options()), "html_to_markdown_minimal": ("markdown", minimal()),
        "html_to_text": ("text", Options()), "html_to_safe_html": ("safe_html", Options()),
    }
    for name, (output, o) in kinds.items():

        def run(html: pd.Series, output=output, o=o) -> pd.Series:
            return html.map(lambda x: convert_one(x, (output,), o)[0])

        run.__annotations__ = {"html": pd.Series, "return": pd.Series}
        spark.udf.register(name, pandas_udf(lambda html, f=run: f(html), "string"))
