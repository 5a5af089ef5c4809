"""Main text of web pages by wrappers: union-free expressions that same-host pages are aligned to.

An expression is a list of items, [kind, name, content, optional]: "E" an element with its key and content, "G" a group
of items that repeats, "T" a slot of text. A slot's content is [places of its texts] in a page, or [pages, characters,
characters in links, least hash, greatest hash] in a wrapper.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship
from .common import sliced, small, staged
from .htmltree import LEAVES, LONGEST_UNIT, marks, parse

#: Expressions that are aligned in one task, bytes of wrappers that may be broadcast, forms that a task adds up before it passes them on.
FAN_IN, BROADCAST_BYTES, HELD_FORMS = 32, 32 << 20, 5_000
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


def label(item: list) -> str:
    """What items must share to be aligned: an element's key, or the labels of a group's unit."""
    kind, name, content, _ = item
    return name if kind == "E" else "#text" if kind == "T" else "+" + "|".join(map(label, content))


def form(item: list) -> str:
    """The item without what its slots hold."""
    kind, name, content, optional = item
    inner = "" if kind == "T" else f"{name}({' '.join(map(form, content))})"
    return f"{kind}{'?' if optional else ''}{inner}"


def joined(a: list, b: list, add) -> list:
    """One item for two of the same label; add(x, y) joins what two slots hold."""
    kind, name, content, optional = a
    content = add(content, b[2]) if kind == "T" else aligned(content, b[2], add)
    return [kind, name, content, optional or b[3]]


def grouped(items: list, unit: str, n: int, add) -> list:
    """Runs of items whose labels make up the unit become groups, repeats of it within a run one group."""
    out: list = []
    for item in items:
        out.append(item)
        if len(out) >= n and not any(i[0] == "G" for i in out[-n:]) and "+" + "|".join(map(label, out[-n:])) == unit:
            group = ["G", "+", out[-n:], False]
            del out[-n:]
            if out and out[-1][0] == "G" and label(out[-1]) == unit:
                out[-1] = joined(out[-1], group, add)
            else:
                out.append(group)
    return out


def aligned(a: list, b: list, add) -> list:
    """The expression of two lists of items.

    Mismatches of a repeat against its unit make both repeats. Then items of equal form are matched first, between
    them items of equal label; what stays alone is optional, or part of a repeat beside it.
    """
    for x, y in ((a, b), (b, a)):
        for group in [i for i in x if i[0] == "G"]:
            unit = label(group)
            if sum(i[0] == "G" and label(i) == unit for i in y) == 0:
                y[:] = grouped(y, unit, len(group[2]), add)
    out: list = []

    def alone(items: list) -> None:
        for item in items:
            if out and out[-1][0] == "G" and len(out[-1][2]) == 1 and label(out[-1][2][0]) == label(item) and marks(item[1])[0] in LEAVES:
                out[-1] = joined(out[-1], ["G", "+", [item], False], add)
            else:
                out.append([*item[:3], True])

    def meet(a: list, b: list, keys) -> None:
        if not a or not b:
            alone(a or b)
            return
        for op, i, j, k, m in SequenceMatcher(None, list(map(keys[0], a)), list(map(keys[0], b)), autojunk=False).get_opcodes():
            if op == "equal":
                out.extend(joined(x, y, add) for x, y in zip(a[i:j], b[k:m], strict=True))
            elif len(keys) > 1:
                meet(a[i:j], b[k:m], keys[1:])
            else:
                alone(a[i:j])
                alone(b[k:m])

    meet(a, b, (form, label))
    return out


def folded(tree: list) -> list:
    """A parsed page as an expression: repeated siblings (units of up to LONGEST_UNIT items of one form, or leaves of one label) become groups; slots list the places of their texts in page order."""
    places = iter(range(1 << 62))

    def leaf(item: list) -> bool:
        return item[0] == "E" and marks(item[1])[0] in LEAVES

    def stack(group: list, shown: str, unit: list, unit_shown: str) -> tuple[list, str]:
        """The group with one more unit: places are appended where forms agree, else the unit is aligned to it."""
        if shown[3:-1] == unit_shown:
            for x, y in zip(slots(group[2]), slots(unit), strict=True):
                x[2].extend(y[2])
            return group, shown
        group = joined(group, ["G", "+", unit, False], list.__add__)
        return group, form(group)

    def fold(items: list) -> list:
        out: list = []
        forms: list[str] = []
        for item in items:
            out.append(["T", "#text", [next(places)], False] if item[0] == "T" else ["E", item[1], fold(item[2]), False])
            forms.append(form(out[-1]))
            for n in range(1, min(LONGEST_UNIT, len(out) - 1) + 1):
                shown, before = " ".join(forms[-n:]), out[-n - 1]
                like = n == 1 and leaf(out[-1])
                if before[0] == "G" and len(before[2]) == n and (forms[-n - 1][3:-1] == shown or (like and before[2][0][1] == out[-1][1])):
                    group, start = before, len(out) - n - 1
                elif len(out) >= 2 * n and (n > 1 or out[-1][0] == "E") and (forms[-2 * n : -n] == forms[-n:] or (like and out[-2][:2] == out[-1][:2])):
                    start = len(out) - 2 * n
                    group = ["G", "+", out[start:-n], False]
                else:
                    continue
                group, shown = stack(group, form(group) if group is not before else forms[start], out[-n:], shown)
                out[start:], forms[start:] = [group], [shown]
                break
        return out

    return fold(tree)


def slots(items: list) -> list[list]:
    """The slots of an expression, in order."""
    return [s for i in items for s in ([i] if i[0] == "T" else slots(i[2]))]


def chosen(items: list) -> list[bool]:
    """For each slot of an expression, whether it holds main text.

    Where the expression has an article, a main element or a body marked as the article's, their slots count, else
    those of the element that most of the text outside links and noise lies in, without lists of links and without slots
    whose text is the same on three pages or more. Noise inside goes: what is never text, menus, asides, forms,
    footers, notices, adverts, comments; of a header its headings stay.
    """
    regions: dict[int, list] = {}
    texts = lambda inner: sum(max(0, s[2][1] - s[2][2]) for s in slots(inner) if len(s[2]) > 1)

    def search(items: list, level: int) -> None:
        for kind, name, content, _ in items:
            if kind == "G":
                search(content, level)
            elif kind == "E":
                tag, words, silent, noise = marks(name)
                body = "articlebody" in words or {"article", "body"} <= words
                if silent or (noise and not (tag in ("article", "main", "body", "html") and not words & {"comment", "comments", "hidden", "reply"})):
                    continue
                rank = 0 if body else 1 if tag == "article" else 2 if tag == "main" or "main" in words and tag not in ("html", "body") else 3
                if rank < 3 and slots(content):
                    regions.setdefault(rank, []).append(content)
                if rank:
                    search(content, level + 1)

    search(items, 0)
    marked = next((regions[r] for r in (0, 1, 2) if r in regions and any(map(kept_any, regions[r]))), None)
    inside: set[int] = set()

    def keep(items: list, dense: bool, header: bool = False) -> None:
        for kind, name, content, _ in items:
            if kind == "T":
                if not header and not (dense and content[0] >= 3 and content[3] == content[4]):
                    inside.add(id(content))
            elif kind == "G":
                keep(content, dense, header)
            else:
                tag, _, silent, noise = marks(name)
                if silent or (noise and tag not in ("article", "body", "html", "main")):
                    continue
                own = slots(content)
                if dense and own and 2 * sum(s[2][2] for s in own) > sum(s[2][1] for s in own) > 0:
                    continue
                keep(content, dense, (header or tag == "header") and tag not in HEADINGS)

    if marked is not None:
        for region in marked:
            keep(region, False)
    else:
        region = items
        while True:
            inner = [c for c in flat(region) if not (marks(c[1])[2] or (marks(c[1])[3] and marks(c[1])[0] not in ("body", "html")))]
            best = max(inner, key=lambda c: texts(c[2]), default=None)
            if best is None or 10 * texts(best[2]) < 7 * sum(texts([c]) for c in region) or marks(best[1])[0] in LEAVES or not texts(best[2]):
                break
            region = best[2]
        keep(region, True)
    return [id(s[2]) in inside for s in slots(items)]


def flat(items: list) -> list:
    """The elements of a list of items, those within groups too."""
    return [e for i in items for e in (flat(i[2]) if i[0] == "G" else [i] if i[0] == "E" else [])]


def kept_any(items: list) -> bool:
    """Whether a slot lies outside all noise."""
    return any(i[0] == "T" or (i[0] == "G" and kept_any(i[2])) or (i[0] == "E" and not marks(i[1])[2] and not (marks(i[1])[3] and marks(i[1])[0] != "header") and kept_any(i[2])) for i in items)


def add_counts(x: list, y: list) -> list:
    return [x[0] + y[0], x[1] + y[1], x[2] + y[2], min(x[3], y[3]), max(x[4], y[4])]


def page_form(page: str) -> tuple[list, list, str]:
    """A page's texts, its expression and the expression's name."""
    tree = parse(page)
    texts: list = []

    def gather(items: list) -> None:
        for item in items:
            texts.append(item) if item[0] == "T" else gather(item[2])

    gather(tree)
    expression = folded(tree)
    return texts, expression, " ".join(map(form, expression))


def bare(items: list) -> list:
    return [[k, n, [] if k == "T" else bare(c), o] for k, n, c, o in items]


def filled(items: list, contents: Iterator) -> list:
    return [[k, n, next(contents) if k == "T" else filled(c, contents), o] for k, n, c, o in items]


def counts_of(texts: list, slot: list) -> list:
    """Pages, characters, characters in links, hash twice, of one page's slot."""
    own = [texts[p] for p in slot[2]]
    h = xxhash.xxh64_intdigest("\n".join(t[1] for t in own)) >> 1
    return [1, sum(len(t[1]) for t in own), sum(t[2] for t in own), h, h]


def host_of(url_col: str) -> Column:
    """The host of an address in lower case; nothing for other values."""
    return F.lower(F.coalesce(F.regexp_extract(F.col(url_col), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


FORMS = "host string, name string, expression string, counts array<array<long>>"


def infer(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One wrapper for each host: host, wrapper (JSON).

    Pages of one form are added up first: texts of a slot by their number, length and least and greatest hash. A host's
    forms are then aligned in groups of FAN_IN until one expression is left, so no task meets more than that many,
    however many pages a host has. Forms are dealt and ordered by their hash, so reruns agree.
    """
    ship(pages.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def out() -> pa.RecordBatch:
            names = pa.array([h for h, _ in held], pa.string()), pa.array([n for _, n in held], pa.string())
            shown = pa.array([json.dumps(e) for e, _ in held.values()], pa.string()), pa.array([c for _, c in held.values()], pa.list_(pa.list_(pa.int64())))
            held.clear()
            return pa.RecordBatch.from_arrays([*names, *shown], names=["host", "name", "expression", "counts"])

        for batch in sliced(batches, 200):
            for host, page in zip(batch["host"].to_pylist(), batch["html"].to_pylist(), strict=True):
                texts, expression, shown = page_form(page)
                counts = [counts_of(texts, s) for s in slots(expression)]
                key = (host, xxhash.xxh128_hexdigest(shown))
                if key in held:
                    held[key] = held[key][0], [add_counts(x, y) for x, y in zip(held[key][1], counts, strict=True)]
                else:
                    held[key] = bare(expression), counts
            if len(held) >= HELD_FORMS:
                yield out()
        yield out()

    found = pages.select(host_of(url_col).alias("host"), F.coalesce(html_col, F.lit("")).alias("html")).mapInArrow(read, FORMS)
    each = found.select("host", "name", F.col("expression"), F.posexplode_outer("counts").alias("slot", "c"))
    each = each.groupBy("host", "name", "slot").agg(F.max(F.when(F.coalesce("slot", F.lit(0)) == 0, F.col("expression"))).alias("expression"), *[f(F.col("c")[k]).alias(f"c{k}") for k, f in enumerate((F.sum, F.sum, F.sum, F.min, F.max))])
    cells = F.sort_array(F.collect_list(F.struct("slot", *[f"c{k}" for k in range(5)])))
    forms = each.groupBy("host", "name").agg(F.max("expression").alias("expression"), F.transform(cells, lambda s: F.array(*[s[f"c{k}"] for k in range(5)])).alias("counts"))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [json.dumps(filled(json.loads(e), iter(c))) for e, c in zip(batch["expression"].to_pylist(), batch["counts"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["host"], batch["name"], pa.array(done, pa.string())], names=["host", "name", "wrapper"])

    def align(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values("name")
        out = None
        for wrapper in rows["wrapper"]:
            out = json.loads(wrapper) if out is None else aligned(out, json.loads(wrapper), add_counts)
        return pd.DataFrame({"host": rows["host"].iloc[:1], "name": rows["name"].iloc[:1], "wrapper": [json.dumps(out)]})

    schema = "host string, name string, wrapper string"
    level = staged(forms.mapInArrow(first, schema))
    while True:
        sizes = level.groupBy("host").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        if sizes.isEmpty():
            return level.select("host", "wrapper")
        dealt = level.join(sizes, "host").withColumn("at", F.pmod(F.xxhash64("name"), F.ceil(F.col("n") / FAN_IN)))
        done = dealt.groupBy("host", "at").applyInPandas(align, schema)
        level = staged(level.join(sizes, "host", "left_anti").select("host", "name", "wrapper").unionAll(done))


@lru_cache(maxsize=512)
def _wrapper(shown: str) -> list:
    return json.loads(shown)


def verdicts(expression: list, texts: list, wrapper: list | None) -> list[bool]:
    """For each slot of a page's expression, whether it holds main text by the host's wrapper, or by the page's own form where the wrapper keeps none of it."""
    own = filled(expression, (counts_of(texts, s) for s in slots(expression)))
    if wrapper:
        keep = chosen(wrapper)
        numbered = filled(bare(expression), ([[], [k]] for k in range(len(slots(expression)))))
        theirs = filled(bare(wrapper), ([[k], []] for k in range(len(keep))))
        both = slots(aligned(theirs, numbered, lambda x, y: [x[0] + y[0], x[1] + y[1]]))
        mine = [False] * len(slots(expression))
        alone = chosen(own)
        for _, _, (of_wrapper, of_page), _ in both:
            for k in of_page:
                mine[k] = any(keep[w] for w in of_wrapper) if of_wrapper else alone[k]
        if any(mine):
            return mine
        return alone
    return chosen(own)


def main_text(page: str, wrapper: str | None, known: dict) -> str:
    """The texts of a page's main slots, in page order, joined by one line feed; known keeps verdicts by form."""
    texts, expression, shown = page_form(page)
    key = (wrapper, shown)
    if key not in known:
        if len(known) >= HELD_FORMS:
            known.clear()
        known[key] = verdicts(expression, texts, _wrapper(wrapper) if wrapper else None)
    places = sorted(p for s, k in zip(slots(expression), known[key], strict=True) if k for p in s[2])
    return "\n".join(texts[p][1] for p in places)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The main text of every page: id, url, text, n_chars.

    Blocks come in page order, character references decoded, white space as one space. A null or empty page has an empty
    text. Null and odd addresses make one host of their own. Each row is a page of its own, whatever its id or url,
    and rows that repeat count that often in the wrapper. Very long pages are read whole. No rows give no rows. Ids can
    have any type. Other columns are not read.
    """
    ship(pages.sparkSession)
    wrappers = infer(pages, url_col, html_col)
    bytes_ = wrappers.agg(F.sum(F.length("wrapper") + F.length("host"))).first()[0] or 0
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(html_col, F.lit("")).alias("html"), host_of(url_col).alias("host"))
    rows = rows.join(small(wrappers, bytes_, BROADCAST_BYTES), "host", "left").select("id", "url", "html", "wrapper")
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("url", rows.schema["url"].dataType), T.StructField("text", T.StringType())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in sliced(batches, 200):
            done = [main_text(page, wrapper, known) for page, wrapper in zip(batch["html"].to_pylist(), batch["wrapper"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["id"], batch["url"], pa.array(done, pa.string())], names=["id", "url", "text"])

    return rows.mapInArrow(read, schema).select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))
