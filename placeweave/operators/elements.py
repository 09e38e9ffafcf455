"""Captured page → flat element table; X4/X5: selector chains and
``closest`` as higher-order expressions over it.

X1 is the one Python-side map of the library: an Arrow-batched
``mapInArrow`` over the stdlib ``html.parser`` and the tree rules of
``htmltree`` (narrow — no shuffle).  A page of any kind, also a fragment, has
the elements that a browser gives it: ``html``, ``head`` and ``body`` are
implied; a null page has none and says so in ``parse_error``.  Per page it
emits

* ``doc_bytes``: every text node of the page concatenated in document order
  (entities decoded, script/style content included, as ``textContent``),
  UTF-8 encoded;
* ``elements``: ``ARRAY<STRUCT<idx, parent, depth, last, tag, attrs, t0, t1>>``
  in document order, where ``idx`` is the element's position in the array
  (0-based), ``parent`` the parent's ``idx`` (-1 at top level), ``last`` the
  ``idx`` of its last descendant, and ``[t0, t1)`` its text range as byte
  offsets into ``doc_bytes``.

So ``e.textContent`` is ``decode(substr(doc_bytes, e.t0 + 1, e.t1 - e.t0))`` —
a byte slice is O(1), whereas a character position in a UTF-8 string can
only be found by scanning from the start — ``d`` is
a descendant of ``e`` iff ``e.idx < d.idx <= e.last``, and the parent is
``elements[parent]``.  Storage is linear in the page (no per-element copies
of text or ancestor lists), and every rule downstream is a per-page HOF:
no shuffle, no per-link copy of the element array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeweave.operators.htmltree import Tree

ELEMENT_DDL = ("STRUCT<idx: INT, parent: INT, depth: INT, last: INT, tag: STRING, "
               "attrs: MAP<STRING, STRING>, t0: INT, t1: INT>")
ELEMENTS_SCHEMA = (f"page_id BIGINT, url STRING, doc_bytes BINARY, elements ARRAY<{ELEMENT_DDL}>, "
                   "text_nodes ARRAY<STRUCT<t0: INT, t1: INT>>, parse_error STRING")


#: Why a page without content has no elements.
NO_CONTENT = "No content captured"


def flatten_html(html: str | None):
    """Python model of X1 for one page: ``(doc_bytes, rows)``; the text-node
    ranges are available from :func:`flatten_html_nodes`."""
    text, rows, _ = flatten_html_nodes(html)
    return text, rows


def flatten_html_nodes(html: str | None):
    """``(doc_bytes, rows, text_nodes)`` for one page (byte offsets)."""
    return flatten_page(html)[:3]


def flatten_page(html: str | None):
    """``(doc_bytes, rows, text_nodes, parse_error)`` for one page.  A page that
    the parser refuses yields no elements and the reason, so a job neither
    dies on it nor passes a part of it off as the whole."""
    if html is None:
        return b"", [], [], NO_CONTENT
    tree = Tree()
    try:
        tree.feed(html)
        tree.finish()
        return *tree.rows(), None
    except Exception as exc:  # noqa: BLE001 — reported per page
        return b"", [], [], f"{type(exc).__name__}: {exc}"


def _arrow_type():
    import pyarrow as pa

    element = pa.struct([("idx", pa.int32()), ("parent", pa.int32()), ("depth", pa.int32()), ("last", pa.int32()),
                         ("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())),
                         ("t0", pa.int32()), ("t1", pa.int32())])
    node = pa.struct([("t0", pa.int32()), ("t1", pa.int32())])
    return pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("doc_bytes", pa.binary()),
                      ("elements", pa.list_(element)), ("text_nodes", pa.list_(node)), ("parse_error", pa.string())])


# Output batches are cut when this many elements have accumulated, so what a
# Python worker holds as Python values does not grow with the input's batches.
MAX_ELEMENTS_PER_OUTPUT_BATCH = 20_000


def _columnar(pages_rows, pages_nodes):
    """Arrow arrays for ``elements`` and ``text_nodes`` built column by column
    (flat value lists + offsets) instead of from nested Python dicts."""
    import pyarrow as pa

    schema = _arrow_type()
    cols = [[] for _ in range(8)]       # idx, parent, depth, last, tag, attrs(map), t0, t1
    keys, vals, attr_off, elem_off = [], [], [0], [0]
    n0, n1, node_off = [], [], [0]
    for rows, nodes in zip(pages_rows, pages_nodes):
        for r in rows:
            for j in (0, 1, 2, 3, 4, 6, 7):
                cols[j].append(r[j])
            keys.extend(r[5].keys())
            vals.extend(r[5].values())
            attr_off.append(len(keys))
        elem_off.append(elem_off[-1] + len(rows))
        for a, b in nodes:
            n0.append(a)
            n1.append(b)
        node_off.append(len(n0))
    i32 = pa.int32()
    attrs = pa.MapArray.from_arrays(pa.array(attr_off, i32), pa.array(keys, pa.string()), pa.array(vals, pa.string()))
    etype = schema.field("elements").type.value_type
    struct = pa.StructArray.from_arrays(
        [pa.array(cols[0], i32), pa.array(cols[1], i32), pa.array(cols[2], i32), pa.array(cols[3], i32),
         pa.array(cols[4], pa.string()), attrs.cast(etype.field("attrs").type), pa.array(cols[6], i32),
         pa.array(cols[7], i32)], fields=list(etype))
    elements = pa.ListArray.from_arrays(pa.array(elem_off, i32), struct)
    ntype = schema.field("text_nodes").type.value_type
    nodes = pa.ListArray.from_arrays(pa.array(node_off, i32), pa.StructArray.from_arrays(
        [pa.array(n0, i32), pa.array(n1, i32)], fields=list(ntype)))
    return elements, nodes


def _flatten_batches(batches, carry=()):
    import pyarrow as pa

    schema = _arrow_type()
    for batch in batches:
        ids, urls, htmls = (batch.column(c) for c in ("page_id", "url", "html"))
        start, texts, rows_acc, nodes_acc, errors, n_elements = 0, [], [], [], [], 0
        for i in range(batch.num_rows):
            text, rows, text_nodes, error = flatten_page(htmls[i].as_py())
            texts.append(text)
            errors.append(error)
            rows_acc.append(rows)
            nodes_acc.append(text_nodes)
            n_elements += len(rows)
            if n_elements >= MAX_ELEMENTS_PER_OUTPUT_BATCH or i == batch.num_rows - 1:
                elements, nodes = _columnar(rows_acc, nodes_acc)
                arrays = [ids.slice(start, i + 1 - start).cast(pa.int64()), urls.slice(start, i + 1 - start).cast(pa.string()),
                          pa.array(texts, pa.binary()), elements, nodes, pa.array(errors, pa.string())]
                names = list(schema.names)
                for c in carry:          # extra page columns pass through untouched
                    arrays.append(batch.column(c).slice(start, i + 1 - start))
                    names.append(c)
                yield pa.RecordBatch.from_arrays(arrays, names=names)
                start, texts, rows_acc, nodes_acc, errors, n_elements = i + 1, [], [], [], [], 0


def page_elements(pages: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """``(page_id, url, doc_bytes, elements, text_nodes, parse_error,
    *carry)`` per page.

    Only ``page_id, url, html`` and the (small, scalar) ``carry`` columns cross
    into Python, so page metadata rides along instead of being joined back
    (which would shuffle the element arrays).  Arrow batches are bounded by the
    session's ``spark.sql.execution.arrow.maxRecordsPerBatch`` and
    ``maxBytesPerBatch``; X1 changes neither."""
    carry = tuple(carry)
    dtypes = dict(pages.dtypes)
    schema = ELEMENTS_SCHEMA + "".join(f", `{c}` {dtypes[c]}" for c in carry)
    return pages.select("page_id", "url", "html", *carry).mapInArrow(
        lambda it: _flatten_batches(it, carry), schema)


# ---------------------------------------------------------------------------
# Element predicates and navigation (used inside HOF lambdas)
# ---------------------------------------------------------------------------

def attr(e: Column, name: str) -> Column:
    """Attribute value or NULL."""
    return F.try_element_at(e["attrs"], F.lit(name))


def has_attr(e: Column, name: str) -> Column:
    return attr(e, name).isNotNull()


def attr_contains(e: Column, name: str, value: str) -> Column:
    """CSS ``[name*="value"]``."""
    return F.coalesce(F.instr(attr(e, name), value) > 0, F.lit(False))


def attr_equals(e: Column, name: str, value: str) -> Column:
    """CSS ``[name="value"]``."""
    return F.coalesce(attr(e, name) == value, F.lit(False))


def attr_starts(e: Column, name: str, value: str) -> Column:
    """CSS ``[name^="value"]``."""
    return F.coalesce(attr(e, name).startswith(value), F.lit(False))


def is_tag(e: Column, tag: str) -> Column:
    return e["tag"] == tag


def text_range(t0: Column, t1: Column, doc_bytes: Column | str = "doc_bytes") -> Column:
    """Text of the byte range ``[t0, t1)`` of the page text."""
    d = F.col(doc_bytes) if isinstance(doc_bytes, str) else doc_bytes
    return F.decode(F.substring(d, t0 + 1, t1 - t0), "UTF-8")


def text_of(e: Column, doc_bytes: Column | str = "doc_bytes") -> Column:
    """``textContent`` of element ``e`` (NULL when ``e`` is NULL); ``e`` is
    bound once, so passing a computed element costs one evaluation."""
    from placeweave.functions.text import let

    return let(e, lambda v: text_range(v["t0"], v["t1"], doc_bytes))


def page_text_of(doc_bytes: Column | str = "doc_bytes") -> Column:
    """The whole page text (all text nodes)."""
    d = F.col(doc_bytes) if isinstance(doc_bytes, str) else doc_bytes
    return F.decode(d, "UTF-8")


def descendants(cands: Column, e: Column) -> Column:
    """Candidates inside ``e`` (document order kept)."""
    return F.filter(cands, lambda c: (c["idx"] > e["idx"]) & (c["idx"] <= e["last"]))


def first_descendant(cands: Column, e: Column) -> Column:
    """``e.querySelector(sel)`` given the candidates matching ``sel``."""
    return F.try_element_at(descendants(cands, e), F.lit(1))


def closest(cands: Column, e: Column) -> Column:
    """``e.closest(sel)`` — ``e`` itself or its nearest ancestor matching."""
    return F.try_element_at(F.filter(cands, lambda c: (c["idx"] <= e["idx"]) & (e["idx"] <= c["last"])),
                            F.lit(-1))


def parent_of(elements: Column | str, e: Column) -> Column:
    """``e.parentElement`` (NULL at the top)."""
    from placeweave.functions.text import let

    els = F.col(elements) if isinstance(elements, str) else elements
    return let(e, lambda v: F.when(v["parent"] >= 0, F.try_element_at(els, v["parent"] + 1)))


def subtree(elements: Column | str, e: Column) -> Column:
    """All descendants of ``e`` in document order: because ``elements`` is in
    document order and ``last`` closes the subtree, they are the contiguous
    slice ``elements[idx+1 .. last]`` — O(subtree), not O(page)."""
    els = F.col(elements) if isinstance(elements, str) else elements
    return F.slice(els, e["idx"] + 2, e["last"] - e["idx"])


def descendants_where(elements: Column | str, e: Column, pred) -> Column:
    """``e.querySelectorAll(sel)`` with ``sel`` given as a predicate."""
    return F.filter(subtree(elements, e), pred)


def first_descendant_where(elements: Column | str, e: Column, pred) -> Column:
    """``e.querySelector(sel)`` with ``sel`` given as a predicate."""
    return F.try_element_at(descendants_where(elements, e, pred), F.lit(1))


def closest_where(elements: Column | str, e: Column, pred) -> Column:
    """X5 by walking up the parents (O(depth)): ``e`` itself or its nearest
    ancestor satisfying ``pred``; NULL when none."""
    els = F.col(elements) if isinstance(elements, str) else elements
    init = F.struct(e.alias("cur"), F.lit(None).cast(ELEMENT_DDL).alias("hit"))

    def step(acc, _):
        cur = acc["cur"]
        hit = F.when(acc["hit"].isNotNull(), acc["hit"]).when(F.coalesce(pred(cur), F.lit(False)), cur)
        up = F.when(cur["parent"] >= 0, F.try_element_at(els, cur["parent"] + 1))
        return F.struct(F.when(hit.isNull(), up).alias("cur"), hit.alias("hit"))
    return F.aggregate(F.sequence(F.lit(0), e["depth"]), init, step, lambda acc: acc["hit"])


def first_match(*candidate_lists: Column) -> Column:
    """The first selector (candidate list) that matches anything wins,
    then its first element in document order."""
    return F.coalesce(*[F.try_element_at(c, F.lit(1)) for c in candidate_lists])


def select(elements: Column | str, pred) -> Column:
    """All elements matching ``pred`` in document order."""
    els = F.col(elements) if isinstance(elements, str) else elements
    return F.filter(els, pred)
