"""Markup as a table of elements in document order, and what JSP pages, menus and links are made of."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A tag with its attributes, and the text up to the next one. Possessive, so that long tags need no stack.
_TAG = r"<(/?)([A-Za-z][\w:.-]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>([^<]*+)"
_ATTRIBUTE = r"([A-Za-z_:][\w:.-]*+)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++))?+"


def without_code(text: Column, el: str | None = "placeholder") -> Column:
    """A page without comments, directives, scriptlets and the contents of scripts and styles; EL becomes ``el``, unless that is None."""
    out = F.regexp_replace(text, r"(?s)<%--.*?--%>", "")
    out = F.regexp_replace(F.regexp_replace(out, r"<%@[^%]*%>", ""), r"<%[^%]*%>", " ")
    if el is not None:
        out = F.regexp_replace(out, r"\$\{[^}]*\}", el)
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", " ")
    return F.regexp_replace(out, r"(?is)(<(script|style)\b[^>]*>).*?(</\2\s*>)", "$1$3")


def unescaped(c: Column) -> Column:
    for name, mark in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("#39", "'"), ("amp", "&")):
        c = F.replace(c, F.lit(f"&{name};"), F.lit(mark))
    return c


def _dealt(files: DataFrame, key: str) -> DataFrame:
    """Texts are far larger than what they are written from and hold far more work, so they are dealt over as many tasks as a shuffle has, which are not merged by size."""
    return files.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def _body(text: str, clean: Column | None) -> Column:
    return F.coalesce(clean if clean is not None else without_code(F.col(text)), F.lit(""))


def tags(files: DataFrame, key: str = "path", text: str = "text", *, clean: Column | None = None) -> DataFrame:
    """(key, at, closing, tag, raw, empty, text): every tag in document order, numbered from 1, with the text that follows it."""
    rows = _dealt(files, key).select(F.col(key).alias("key"), F.posexplode(F.regexp_extract_all(_body(text, clean), F.lit(f"({_TAG})"), F.lit(1))).alias("at", "token"))
    # A token begins like a tag, so its parts follow each other: what the whole pattern must tell is only where the attributes end.
    name, closing = F.regexp_extract("token", r"^</?([A-Za-z][\w:.-]*+)", 1), F.startswith("token", F.lit("</"))
    rows = rows.select("key", (F.col("at") + 1).alias("at"), closing.alias("closing"), name.alias("name"), F.regexp_extract("token", f"(?s)^{_TAG}$", 3).alias("raw"), "token")
    text = F.substring("token", F.length("name") + F.length("raw") + F.when(F.col("closing"), 4).otherwise(3), F.lit(1 << 30))
    rows = rows.select("key", "at", "closing", F.lower("name").alias("tag"), "raw", text.alias("text"))
    return rows.withColumn("empty", ~F.col("closing") & F.col("raw").rlike(r"/\s*$"))


#: So many elements are handed on together.
_ROWS = 10_000
_WHITE = " \t\n\x0b\f\r"
_MARKS = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&amp;", "&"))
# The same patterns for the sweep, which takes a closing tag's slash with its name and finds the text behind by itself; names, digits and white space are those of ASCII in both.
_TAGS, _ATTRIBUTES = re.compile(_TAG.replace("(/?)(", "(/?").removesuffix("([^<]*+)"), re.ASCII), re.compile(_ATTRIBUTE, re.ASCII)


class _Codes(dict):
    """Twice a number for each name as it comes, and one more for a closing tag's; capitals don't count."""

    def __init__(self):
        super().__init__()
        self.names: list[str] = []

    def __missing__(self, name: str) -> int:
        low = name.lower()
        if low != name:
            self[name] = self[low]
        elif name[0] == "/":
            self[name] = self[name[1:]] + 1
        else:
            self[name] = 2 * len(self.names)
            self.names.append(name)
        return self[name]


def _read(raw: str) -> dict[str, str]:
    """The attributes of a tag: name (lower-cased) to value; a name without a value has the empty one, of a repeated name the first counts."""
    out: dict[str, str] = {}
    for name, value in _ATTRIBUTES.findall(raw):
        name = name.lower()
        if name not in out:
            value = value[1:-1] if value[:1] in ('"', "'") else value
            if "&" in value:
                for said, mark in _MARKS:
                    value = value.replace(said, mark)
            out[name] = value
    return out


def _nested(codes: array, empty: bytearray, only: frozenset[int], owners: frozenset[int], within: array) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(at, last, parent, depth, n, owner) of each open tag of a file, or of those named in ``only``: its end, the element around it, how many are, how many names
    are open around it, of which ``within`` gets (name, at, n), and the innermost element around it that is named in ``owners``.

    A closing tag closes the last open one of its name, and one without an open one counts for nothing. A tag that nothing closes holds only itself, as an
    empty one does.
    """
    last, stacks = array("i", range(1, len(codes) + 1)), {}
    for i, code in enumerate(codes):
        if code & 1:
            if stacks.get(code - 1):
                last[stacks[code - 1].pop()] = i + 1
        elif not empty[i]:
            stacks.setdefault(code, []).append(i)
    open_, named, flat, soonest, owner = [], {}, [], 0, 0
    for i, code in enumerate(codes):
        at, end, wanted = i + 1, last[i], not only or code in only
        if code & 1 or end == at and not wanted:
            continue
        while open_ and open_[-1][1] < at:
            open_.pop()
        if named and soonest < at:
            for over in [n for n, stack in named.items() if stack[-1][1] < at]:
                stack = named[over]
                while stack and stack[-1][1] < at:
                    stack.pop()
                if not stack:
                    del named[over]
            flat, soonest = None, min((stack[-1][1] for stack in named.values()), default=0)
            owner = max((stack[-1][0] for n, stack in named.items() if n in owners), default=0) if owners else 0
        depth = open_[-1][2] + 1 if open_ else 0
        if wanted:
            if flat is None:
                flat = [x for n, stack in named.items() for x in (n >> 1, stack[-1][0], len(stack))]
            within.extend(flat)
            yield at, end, open_[-1][0] if open_ else 0, depth, len(named), owner
        if end > at:
            open_.append((at, end, depth))
            flat, soonest = None, min(soonest, end) if named else end
            named.setdefault(code, []).append((at, end))
            owner = at if code in owners else owner


def _sweep(batches: Iterator[pa.RecordBatch], only: Sequence[str], owners: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """The elements of files (key, body), each file by itself."""
    codes, within = _Codes(), array("i")
    kept, holders = frozenset(codes[x] for x in only), frozenset(codes[x] for x in owners)
    rows, words, values, said = [], [], [], []

    def made(keys: pa.Array) -> Iterator[pa.RecordBatch]:
        file, tag, at, last, parent, depth, sizes, n_words = (pa.array(x, "int32") for x in zip(*rows, strict=True))
        flat = np.array(within, dtype="int32").reshape(-1, 3)
        around = pa.StructArray.from_arrays([pa.array(flat[:, 1]), pa.array(flat[:, 2])], ["at", "n"])
        begins = lambda n: pa.array(np.concatenate([[0], np.cumsum(n.to_numpy())]).astype("int32"))
        names = pa.array(codes.names, "string")
        columns = {
            "key": keys.take(file), "at": at, "last": last, "tag": names.take(tag), "attributes": pa.MapArray.from_arrays(begins(n_words), pa.array(words, "string"), pa.array(values, "string")),
            "text": pa.array([x[0] for x in said], "string"), "parent": parent, "depth": depth, "within": pa.MapArray.from_arrays(begins(sizes), names.take(pa.array(flat[:, 0])), around),
        }
        if owners:
            columns |= {"owner": pa.array([x[1] or None for x in said], "int32"), "owner_name": pa.array([x[2] for x in said], "string")}
        yield pa.RecordBatch.from_pydict(columns)
        for held in (rows, words, values, said, within):
            del held[:]

    for batch in batches:
        keys = batch["key"]
        for file, body in enumerate(batch["body"]):
            body = body.as_py()
            # Tags are held as numbers, since a file may have many: where attributes begin and end.
            empty, numbers, starts, stops = bytearray(), array("i"), array("i"), array("i")
            for tag in _TAGS.finditer(body):
                begins, ends = tag.span(2)
                numbers.append(codes[tag[1]])
                starts.append(begins)
                stops.append(ends)
                end = body[ends - 1]
                empty.append(end == "/" or end in _WHITE and body[begins:ends].rstrip(_WHITE).endswith("/"))
            holder, named = 0, None
            for at, last, parent, depth, n, owner in _nested(numbers, empty, kept, holders, within):
                ends = stops[at - 1]
                read = _read(body[starts[at - 1]:ends])
                if owner != holder:
                    holder, named = owner, _read(body[starts[owner - 1]:stops[owner - 1]]).get("id") if owner else None
                rows.append((file, numbers[at - 1] >> 1, at, last, parent, depth, n, len(read)))
                words.extend(read)
                values.extend(read.values())
                behind = body.find("<", ends)
                said.append((body[ends + 1:behind] if behind >= 0 else body[ends + 1:], owner, named))
                if len(rows) >= _ROWS:
                    yield from made(keys)
        if rows:
            yield from made(keys)


def elements(files: DataFrame, key: str = "path", text: str = "text", *, clean: Column | None = None, only: Sequence[str] = (), owners: Sequence[str] = ()) -> DataFrame:
    """(key, at, last, tag, attributes, text, parent, depth, within): the elements of markup in document order.

    ``at`` numbers an element's tag and ``last`` the tag that closes it, so one lies inside another if its ``at`` is between those two.
    ``parent`` is the number of the enclosing element (0: none), ``depth`` how many enclose it, ``within`` for each name the innermost
    enclosing element of that name (at) and how many of it enclose (n). ``text`` is what follows the tag directly. Tags need not
    nest: a closing tag closes the last open one of its name, and an element that nothing closes holds only itself; where two
    overlap, the later begun is the parent as long as it is last. Nulls and texts without tags have no rows. A file is cut into its tags
    and swept where its text is, without a shuffle or sort of tags; memory holds the tags of one file. Numbers are those of ``tags``.

    Where a reader needs the elements of some names ``only``, all tags are swept still, but attributes are read and rows made for those alone. With ``owners``,
    ``owner`` is the innermost element of any of these names around an element and ``owner_name`` its id, so that no join must find them.
    """
    only, owners = tuple(only), tuple(owners)
    bodies = _dealt(files, key).select(F.col(key).alias("key"), _body(text, clean).alias("body"))
    schema = f"key {dict(bodies.dtypes)['key']}, at int, last int, tag string, attributes map<string, string>, text string, parent int, depth int, within map<string, struct<at: int, n: int>>"
    return bodies.mapInArrow(lambda batches: _sweep(batches, only, owners), schema + (", owner int, owner_name string" if owners else ""))


def attribute(name: str) -> Column:
    """An element's attribute; null where it is missing or empty."""
    return F.nullif(F.element_at("attributes", name), F.lit(""))


def has(name: str) -> Column:
    return F.map_contains_key("attributes", F.lit(name))


def inside(tag: str) -> Column:
    """The number of the innermost element of a name around an element."""
    return F.element_at("within", tag)["at"]


def inner_texts(found: DataFrame, all_tags: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """(key, at, inner): the text inside each element of some names, without what lies in a further element of them.

    Every tag's text belongs to the innermost of these elements that is open behind it. White space at both ends goes.
    """
    from codelattice.operators.intervals import innermost

    own = found.where(F.col("tag").isin(*names) & (F.col("last") > F.col("at"))).select("key", F.col("at").alias("owner"), F.col("at").alias("first"), (F.col("last") - 1).alias("last"))
    texts = all_tags.where(F.trim("text") != "").select("key", F.struct("key", "at", unescaped(F.col("text")).alias("text")).alias("id"), "at")
    got = innermost(texts, own, "key").groupBy(F.col("id.key").alias("key"), F.col("owner").alias("at"))
    return got.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id.at", "id.text"))), lambda x: x["text"]), "").alias("inner")).withColumn("inner", F.regexp_replace("inner", r"^\s+|\s+$", ""))


def forms(found: DataFrame) -> DataFrame:
    """(key, form, at, name, action, method, enctype): a page's forms, numbered and named from 0."""
    number = F.row_number().over(Window.partitionBy("key").orderBy("at")) - 1
    rows = found.where("tag = 'form'").select("key", "at", F.coalesce(attribute("action"), F.lit("")).alias("action"), F.upper(F.coalesce(attribute("method"), F.lit("GET"))).alias("method"), attribute("enctype").alias("enctype"))
    return rows.withColumn("form", number).select("key", "form", "at", F.concat(F.lit("form"), F.col("form").cast("string")).alias("name"), "action", "method", "enctype")


def _option_rows(found: DataFrame, all_tags: DataFrame) -> DataFrame:
    """(key, select_at, option): the options of selects, each with its place, value, label and is_default."""
    own = found.where("tag = 'option'").select("key", "at", inside("select").alias("select_at"), attribute("value").alias("said"), F.trim(unescaped(F.col("text"))).alias("behind"), has("selected").alias("is_default")).where("select_at is not null")
    rows = own.join(inner_texts(found, all_tags, ("option",)), ["key", "at"], "left").withColumn("inner", F.coalesce("inner", "behind"))
    value = F.coalesce("said", "inner", F.lit(""))
    return rows.select("key", "select_at", F.struct("at", value.alias("value"), F.coalesce(F.nullif("inner", F.lit("")), value).alias("label"), "is_default").alias("option"))


def _in_order(options: Column) -> Column:
    return F.transform(F.array_sort(options), lambda x: F.struct(x["value"].alias("value"), x["label"].alias("label"), x["is_default"].alias("is_default")))


def options(found: DataFrame, all_tags: DataFrame) -> DataFrame:
    """(key, select_at, options): the options of each select element in order: value, label, is_default."""
    return _option_rows(found, all_tags).groupBy("key", "select_at").agg(_in_order(F.collect_list("option")).alias("options"))


def fields(found: DataFrame, all_tags: DataFrame) -> DataFrame:
    """The named input, select and textarea elements of each form: (key, form_at, at, name, type, required, read_only, disabled, default_value, label, placeholder,
    help_text, pattern, min, max, min_length, max_length, options).

    The label is the first of: the text of the form's first ``label`` for the element's id (else name), that of a label around it, its
    ``aria-label``, the text of the element before it if that is a label or its class says so, and of the table cell before its own with such a class.

    Where a label stands is found by places alone, which meet the texts once; the fields themselves meet their neighbours, and then what was found.
    """
    number = lambda name: attribute(name).try_cast("int")
    name, form_at = attribute("name"), inside("form")
    field = F.struct(
        form_at.alias("form_at"), name.alias("name"), F.coalesce(attribute("type"), "tag").alias("type"), has("required").alias("required"), has("readonly").alias("read_only"), has("disabled").alias("disabled"),
        attribute("value").alias("default_value"), attribute("aria-label").alias("aria"), attribute("placeholder").alias("placeholder"), attribute("title").alias("help_text"), attribute("pattern").alias("pattern"),
        attribute("min").alias("min"), attribute("max").alias("max"), number("minlength").alias("min_length"), number("maxlength").alias("max_length"))
    places = F.struct(form_at.alias("form_at"), F.coalesce(attribute("id"), name).alias("for_id"), inside("td").alias("cell"), inside("label").alias("around"))
    is_field = F.col("tag").isin("input", "select", "textarea") & name.isNotNull() & form_at.isNotNull()
    labelish = F.coalesce(F.contains(attribute("class"), F.lit("label")), F.lit(False))
    siblings = Window.partitionBy("key", "parent").orderBy("at")
    placed = found.select("key", "parent", "at", F.when((F.col("tag") == "label") | labelish, F.col("at")).alias("mark"), F.when(is_field, places).alias("p"))
    placed = placed.withColumn("before_at", F.lag("mark").over(siblings)).where("p is not null").select("key", "at", "p.*", "before_at")
    marked = found.where("tag = 'td'").select("key", "parent", F.col("at").alias("cell"), F.when(labelish, F.col("at")).alias("mark"))
    cells = marked.withColumn("ref", F.lag("mark").over(Window.partitionBy("key", "parent").orderBy("cell"))).where("ref is not null").select("key", "cell", "ref")
    named = found.where("tag = 'label'").select("key", form_at.alias("form_at"), attribute("for").alias("for_id"), "at").where("form_at is not null and for_id is not null")
    named = named.groupBy("key", "form_at", "for_id").agg(F.min("at").alias("ref"))
    at = lambda df, rank, ref: df.select("key", "at", F.lit(rank).alias("rank"), F.col(ref).alias("ref"))
    refs = at(placed.join(named, ["key", "form_at", "for_id"]), 0, "ref").union(at(placed.where("around is not null"), 1, "around")).union(
        at(placed.where("before_at is not null"), 3, "before_at")).union(at(placed.where("cell is not null").join(cells, ["key", "cell"]), 4, "ref"))
    texts = inner_texts(found, all_tags, ("label", "td", "th", "span", "div", "option", "textarea", "button", "a")).where("inner <> ''").withColumnRenamed("at", "ref")
    said = refs.join(texts, ["key", "ref"]).select("key", "at", F.struct("rank", "inner").alias("said"))
    listed = _option_rows(found, all_tags).withColumnRenamed("select_at", "at")
    facts = said.unionByName(listed, allowMissingColumns=True).groupBy("key", "at").agg(F.min("said").alias("said"), _in_order(F.collect_list("option")).alias("options"))
    rows = found.where(is_field).select("key", "at", field.alias("f")).select("key", "at", "f.*").join(facts, ["key", "at"], "left")
    label = F.when(F.col("said.rank") < 2, F.col("said.inner")).otherwise(F.coalesce("aria", "said.inner"))
    return rows.select(
        "key", "form_at", "at", "name", "type", "required", "read_only", "disabled", "default_value", label.alias("label"), "placeholder", "help_text", "pattern", "min", "max", "min_length", "max_length",
        F.when(F.size("options") > 0, F.col("options")).alias("options"))


def submits(found: DataFrame, all_tags: DataFrame) -> DataFrame:
    """(key, form_at, at, type, name, value) of what sends a form: submit, button and image inputs, and buttons."""
    rows = found.where((F.col("tag") == "button") | (F.col("tag") == "input") & F.lower(attribute("type")).isin("submit", "button", "image")).join(inner_texts(found, all_tags, ("button",)), ["key", "at"], "left")
    return rows.select("key", inside("form").alias("form_at"), "at", F.coalesce(attribute("type"), F.lit("button")).alias("type"), attribute("name").alias("name"),
                       F.coalesce(attribute("value"), F.nullif("inner", F.lit(""))).alias("value")).where("form_at is not null")


def data_tables(found: DataFrame, all_tags: DataFrame) -> DataFrame:
    """(key, at, name, source, paginated, columns): tables with an id or a table class and their header cells, and display tables with their columns;
    a column is (header, field, type, sortable)."""
    texts = inner_texts(found, all_tags, ("th", "td"))
    word = lambda *names: F.arrays_overlap(F.split(F.coalesce(attribute("class"), F.lit("")), r"\s+"), F.array(*map(F.lit, names)))
    plain = found.where((F.col("tag") == "table") & (attribute("id").isNotNull() | word("data-table", "display-table")))
    unnamed = F.row_number().over(Window.partitionBy("key", attribute("id").isNull()).orderBy("at")) - 1
    plain = plain.select("key", "at", F.coalesce(attribute("id"), F.concat(F.lit("table_"), unnamed.cast("string"))).alias("name"), F.coalesce(attribute("data-source"), F.lit("")).alias("source"), (word("paginated") | has("data-paginated")).alias("paginated"))
    # The header row is the first one of a head, else the first of the table.
    rows = found.where("tag = 'tr'").select("key", F.col("at").alias("row"), inside("table").alias("at"), inside("thead").isNull().alias("body"))
    heads = rows.groupBy("key", "at").agg(F.min_by("row", F.struct("body", "row")).alias("row"))
    cells = found.where(F.col("tag").isin("th", "td")).withColumn("row", inside("tr")).join(texts.withColumnRenamed("at", "cell"), (found["key"] == texts["key"]) & (F.col("at") == F.col("cell")), "left").select(
        found["key"], "row", "at", "inner", "attributes")
    number = F.row_number().over(Window.partitionBy("key", "row").orderBy("at"))
    kind = F.when(word("actions", "action"), "action").when(word("currency"), "currency").when(word("date"), "date").when(word("number", "numeric"), "number").otherwise("text")
    cells = cells.select("key", "row", F.struct("at", F.coalesce(F.nullif("inner", F.lit("")), F.concat(F.lit("Column "), number.cast("string"))).alias("header"), F.coalesce(attribute("data-field"), attribute("property")).alias("field"),
                                                kind.alias("type"), (has("data-sortable") | word("sortable")).alias("sortable")).alias("c"))
    listed = lambda df, *by: df.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list("c")), lambda x: x.dropFields("at")).alias("columns"))
    one = plain.join(heads, ["key", "at"]).join(listed(cells, "key", "row"), ["key", "row"]).select("key", "at", "name", "source", "paginated", "columns")
    shown = found.where("tag = 'display:table'")
    unnamed = F.row_number().over(Window.partitionBy("key", attribute("id").isNull()).orderBy("at")) - 1
    shown = shown.select("key", "at", F.coalesce(attribute("id"), F.concat(F.lit("displaytable_"), unnamed.cast("string"))).alias("name"), F.coalesce(attribute("name"), F.lit("")).alias("source"), attribute("pagesize").rlike(r"^\d+$").alias("paginated"))
    columns = found.where("tag = 'display:column'").select("key", inside("display:table").alias("at"), F.struct("at", F.coalesce(attribute("title"), attribute("property"), F.lit("Column")).alias("header"), attribute("property").alias("field"),
                                                          F.lit("text").alias("type"), (F.coalesce(attribute("sortable"), F.lit("")) == "true").alias("sortable")).alias("c"))
    two = shown.join(listed(columns, "key", "at"), ["key", "at"], "left").where("columns is not null or source <> ''")
    return one.union(two.select("key", "at", "name", "source", F.coalesce("paginated", F.lit(False)), "columns"))


def bindings(raw: DataFrame) -> DataFrame:
    """(key, at, type, path, field, model, required, max_length) of Spring form tags and the model attribute of the form around each. ``raw`` are
    elements whose EL is kept (``without_code(text, None)``)."""
    kinds = {"form:input": "input", "form:select": "select", "form:textarea": "textarea", "form:checkbox": "checkbox", "form:radiobutton": "radio"}
    around = raw.where("tag = 'form:form'").select("key", F.col("at").alias("form_at"), F.coalesce(attribute("modelattribute"), attribute("commandname")).alias("model"))
    rows = raw.where(F.col("tag").isin(*kinds)).select("key", "at", F.element_at(F.create_map(*(F.lit(x) for kv in kinds.items() for x in kv)), F.col("tag")).alias("type"), attribute("path").alias("path"),
                                                       inside("form:form").alias("form_at"), (has("required")).alias("required"), attribute("maxlength").try_cast("int").alias("max_length"))
    return rows.where("path is not null").join(around, ["key", "form_at"], "left").select("key", "at", "type", "path", F.regexp_extract("path", r"([^.]*)$", 1).alias("field"), "model", "required", "max_length")


def page_parts(files: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """(key, part, name, value): includes (directive or action), tag libraries (prefix, URI), the tags used of each, EL expressions and
    page directives; each once. These are read from the text itself, since they live in directives."""
    body = F.coalesce(F.regexp_replace(text, r"(?s)<%--.*?--%>", ""), F.lit(""))
    all_of = lambda p, n=1, c=body: F.regexp_extract_all(c, F.lit(p), F.lit(n))
    one = lambda part, names, values: F.zip_with(names, values, lambda a, b: F.struct(F.lit(part).alias("part"), a.alias("name"), b.alias("value")))
    said = lambda c, a: F.regexp_extract(c, rf"\b{a}\s*=\s*[\"']([^\"']+)[\"']", 1)
    same = lambda part, names, value: F.transform(names, lambda a: F.struct(F.lit(part).alias("part"), a.alias("name"), value(a).alias("value")))
    libraries = all_of(r"<%@\s*taglib([^%]*)%>")
    encodings = F.transform(all_of(r"<%@\s*page([^%]*)%>"), lambda d: said(d, "pageEncoding"))
    listed = F.concat(
        same("include", all_of(r"<%@\s*include\s+file\s*=\s*[\"']([^\"']+)[\"']"), lambda a: F.lit("directive")), same("include", all_of(r"<jsp:include\b[^>]*\bpage\s*=\s*[\"']([^\"']+)[\"']"), lambda a: F.lit("action")),
        F.filter(F.transform(libraries, lambda d: F.struct(F.lit("taglib").alias("part"), said(d, "prefix").alias("name"), said(d, "uri").alias("value"))), lambda x: (x["name"] != "") & (x["value"] != "")),
        one("tag", all_of(r"<(\w+):(\w+)", 1), all_of(r"<(\w+):(\w+)", 2)), same("expression", all_of(r"\$\{([^}]*)\}"), lambda a: F.lit("")), same("encoding", F.filter(encodings, lambda x: x != ""), lambda a: F.lit("")),
    )
    rows = files.select(F.col(key).alias("key"), F.inline(F.array_distinct(listed))).withColumn("name", F.trim("name"))
    # Tags count for the libraries that the page declares.
    known = rows.where("part = 'taglib'").select("key", F.col("name").alias("prefix")).distinct()
    used = rows.where("part = 'tag'").join(known, ["key"]).where("name = prefix").drop("prefix")
    return rows.where("part <> 'tag' and name <> ''").distinct().unionByName(used.select("key", "part", "name", "value"))


def menu_entries(found: DataFrame, all_tags: DataFrame) -> DataFrame:
    """(key, at, label, url, parent_label, level, roles, flow, view, mode, source) of menus written as nested beans.

    A bean of a MenuItem class takes label (or name) and url (or href) from its own properties, else from its first and second constructor arguments.
    Separators, unlabelled beans and all that lies in them are left out; roles come from the requiredRoles, roles or authorities
    property. The parent is the bean around it and the level how many there are, with itself; pages and modes are read from the URL.
    """
    from codelattice.operators.lineage import cut
    from codelattice.sources.parsers import menu_target

    texts = inner_texts(found, all_tags, ("value",))
    values = found.where("tag = 'value'").join(texts, ["key", "at"]).select("key", "parent", "at", "inner")
    said = found.where(F.col("tag").isin("property", "constructor-arg")).withColumn("said", attribute("value"))
    direct = said.join(values.groupBy("key", F.col("parent").alias("at")).agg(F.min_by("inner", "at").alias("inner")), ["key", "at"], "left").select(
        "key", "at", "tag", F.col("parent").alias("bean"), attribute("name").alias("name"), F.coalesce("said", "inner").alias("value"))
    order = F.row_number().over(Window.partitionBy("key", "bean", "tag").orderBy("at"))
    direct = direct.withColumn("nth", F.when(F.col("tag") == "constructor-arg", order))
    pick = lambda *names: F.coalesce(*(F.min_by(F.when(F.col("name") == n, F.col("value")), F.when(F.col("name") == n, F.col("at"))) for n in names))
    nth = lambda n: F.max(F.when(F.col("nth") == n, F.col("value")))
    facts = direct.groupBy("key", F.col("bean").alias("at")).agg(F.coalesce(pick("label", "name"), nth(1)).alias("label"), F.coalesce(pick("url", "href"), nth(2)).alias("url"))
    role_properties = found.where((F.col("tag") == "property") & attribute("name").isin("requiredRoles", "roles", "authorities")).select("key", F.col("at").alias("property"), F.col("parent").alias("bean"), attribute("value").alias("value"))
    listed = found.where("tag = 'value'").select("key", "at", inside("property").alias("property"), inside("bean").alias("bean")).join(texts, ["key", "at"])
    roles = role_properties.where("value is not null").select("key", "bean", F.trim("value").alias("role")).union(
        role_properties.drop("value").join(listed, ["key", "property", "bean"]).select("key", "bean", F.col("inner").alias("role")))
    roles = roles.groupBy("key", F.col("bean").alias("at")).agg(F.array_sort(F.collect_set("role")).alias("roles"))
    beans = found.where((F.col("tag") == "bean") & F.contains(F.lower(F.coalesce(attribute("class"), F.lit(""))), F.lit("menuitem")))
    rows = beans.select("key", "at", "last", inside("bean").alias("up"), F.coalesce(F.element_at("within", "bean")["n"], F.lit(0)).alias("level")).join(facts, ["key", "at"], "left").join(roles, ["key", "at"], "left")
    rows = cut(rows, "menu")
    from codelattice.operators.intervals import innermost

    hidden = (F.coalesce("label", F.lit("")) == "") | F.lower("label").isin("---", "-", "separator")
    out = rows.where(hidden).select("key", F.col("at").alias("owner"), (F.col("at") + 1).alias("first"), "last")
    gone = innermost(rows.select("key", F.struct("key", "at").alias("id"), "at"), out, "key").select("id.key", "id.at")
    shown = rows.where(~hidden).join(gone, ["key", "at"], "left_anti")
    above = shown.select("key", F.col("at").alias("up"), F.col("label").alias("parent_label"))
    m = shown.join(above, ["key", "up"], "left").withColumn("m", menu_target(F.coalesce("url", F.lit(""))))
    return m.select("key", "at", "label", F.coalesce("url", F.lit("")).alias("url"), "parent_label", (F.col("level") + 1).alias("level"), F.coalesce("roles", F.array().cast("array<string>")).alias("roles"), "m.flow", "m.view", "m.mode", "m.source")
