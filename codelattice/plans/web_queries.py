"""Queries of pages, menus and flows: the elements of the raw pages, and JSP pages, menu files and flow files that are
written by rule from the relational tables and then parsed. The SQL states what the rule put into them.

Every customer is a page with three forms and a flow whose states are the customer's orders, each leading to the next and the last
to the first; every region is a menu file of its nations and their customers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelattice.operators import retrieval
from codelattice.operators.lineage import cut
from codelattice.plans.table_queries import query
from codelattice.sources import elements, flows

QUERIES, ORACLES = {}, {}  # these register with the table queries



def _written(*parts) -> F.Column:
    """The parts joined: strings are themselves, columns their text."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _joined(df: DataFrame, by: str, order: str, piece, name: str) -> DataFrame:
    g = df.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(order, piece.alias("piece")))).alias("x"))
    return g.select(by, F.array_join(F.transform("x", lambda r: r["piece"]), "\n").alias(name))


def jsp_pages(t) -> DataFrame:
    """(path, text): a page for each customer. Orders are fields whose labels stand in four ways by their key; decoys stand in comments and scripts."""
    k, c = F.col("o_orderkey"), F.col
    label = F.when(k % 4 == 0, _written('<label for="o', k, '">Order <b>', c("o_orderpriority"), "</b></label>")).when(k % 4 == 2, _written('<span class="small label">Order ', c("o_orderpriority"), "</span>")).otherwise("")
    aria = F.when(k % 4 == 1, _written(' aria-label="Order ', c("o_orderpriority"), '"')).otherwise("")
    rest = _written(' name="o', k, '"', aria, F.when(k % 3 == 0, " required").otherwise(""), F.when(k % 5 == 0, _written(' maxlength="', k % 90, '"')).otherwise(""))
    field = F.when(c("o_orderstatus") == "F", _written("<textarea", rest, "></textarea>")).otherwise(_written('<input type="number"', rest, ' value="a &lt; b > ', k, '"/>'))
    orders = _joined(t("orders"), "o_custkey", "o_orderkey", F.concat(label, field), "fields")
    n, key = c("c_nationkey"), c("c_custkey")
    page = _written(
        '<%@ page contentType="text/html" pageEncoding="UTF-8" %>\n<%@ taglib uri="http://forms/', n, '" prefix="form" %>\n<%@ taglib uri="http://core" prefix="c" %>\n<%@ include file="/head', n, '.jsp" %>\n<jsp:include page="/menu.jsp"/>\n',
        '<%-- <form action="never"><input name="never"></form> --%><!-- <form action="ghost"><input name="ghost"></form> -->\n<script>var s = "<form><input name=\'x\'>";</script><% if (a > 1) { %>\n',
        '<div class="top"><form action="/save/', key, '" method="post">\n', F.coalesce("fields", F.lit("")), '\n<input type="submit" value="Save"/><button name="more">More <i>now</i></button></form></div>\n',
        '<form action="${ctx}/find"><label>Status <select name="status"><option value="O" selected>Open</option><option> Done </option></select></label></form>\n<c:if test="${customer.id > 0}">x</c:if>\n',
        '<table id="t', key, '" class="data-table paginated" data-source="orders"><thead><tr><th data-field="key" class="number sortable">Key</th><th>Date<br></th></tr></thead>',
        '<tr><td class="label">Total</td><td><form enctype="text/plain"><input name="total" readonly></form></td></tr></table>\n<display:table name="list', n, '" pagesize="20"><display:column property="a" sortable="true"/><display:column title="B"/></display:table>\n',
        '<form:form modelAttribute="customer', n, '"><form:input path="address.street', n, '" required="true" maxlength="30"/><form:select path="kind"/></form:form><form:checkbox path="free"/></body>',
    )
    return t("customer").join(orders, c("c_custkey") == c("o_custkey"), "left").select(key.alias("path"), page.alias("text"))


def menu_files(t) -> DataFrame:
    """(path, text): a menu file for each region; nations lie in it, and customers in their nation; every seventh customer is a separator with an item inside."""
    c = F.col
    url = _written("flow", c("c_custkey"), ".html?pageSelect=", F.when(c("c_custkey") % 3 == 0, "orderInquiry").when(c("c_custkey") % 3 == 1, "orderWizardStart").otherwise("order"), F.when(c("c_custkey") % 5 == 0, "&amp;mode=EDIT").otherwise(""))
    own = _written('<bean class="a.MenuItem"><property name="label" value="', c("c_name"), '"/><property name="url"><value>', url, '</value></property><property name="roles"><list><value>R', c("c_custkey") % 4, "</value><value> ALL </value></list></property></bean>")
    hidden = _written('<bean class="a.MenuItem"><property name="label" value="---"/><property name="children"><list>', own, "</list></property></bean>")
    items = _joined(t("customer"), "c_nationkey", "c_custkey", F.when(c("c_custkey") % 7 == 0, hidden).otherwise(own), "items")
    nation = _written('<bean class="a.MenuItem" id="n', c("n_nationkey"), '"><constructor-arg value="', c("n_name"), '"/><constructor-arg value="nation.html"/><constructor-arg><list>', F.coalesce("items", F.lit("")), "</list></constructor-arg></bean>")
    nations = t("nation").join(items, c("n_nationkey") == c("c_nationkey"), "left")
    region = _joined(nations, "n_regionkey", "n_nationkey", nation, "nations")
    return t("region").join(region, c("r_regionkey") == c("n_regionkey")).select(
        c("r_regionkey").alias("path"), _written('<beans><util:list id="mainMenu"><!-- <bean class="a.MenuItem"/> --><bean class="a.Other"/><bean class="a.MenuItem"><property name="name" value="', c("r_name"), '"/><property name="requiredRoles" value="ADMIN"/>',
                                                '<property name="menuItems"><list>', c("nations"), "</list></property></bean></util:list></beans>").alias("text"))


def flow_files(t) -> DataFrame:
    """(path, text): a flow for each customer with orders; open orders are screens, finished ones actions and others decisions."""
    c = F.col
    # Orders meet before they are written out as states, so that keys are shuffled and sorted, not texts.
    g = t("orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus", "o_orderpriority"))).alias("x"))
    name = lambda r: F.concat(F.lit("s"), r["o_orderkey"].cast("string"), F.when((r["o_orderstatus"] == "O") & (r["o_orderkey"] % 4 == 2), "Wizard").otherwise(""))
    g = g.select("o_custkey", "x", F.transform("x", name).alias("names"))

    def state(r, at):
        k, to_first = r["o_orderkey"], c("names")[0]
        to_next = F.coalesce(F.get("names", at + 1), to_first)
        mode = F.when(k % 4 == 0, '<set name="flowScope.maintenanceMode" value="true"/>').when(k % 4 == 1, '<set name="viewScope.editMode" value="false"/>').otherwise("")
        view = _written('<view-state id="s', k, F.when(k % 4 == 2, "Wizard").otherwise(""), '"', F.when(k % 3 == 0, _written(' view="page', c("o_custkey"), '.jsp"')).otherwise(""), '><on-entry><evaluate expression="orderAction.load(x)"/><set name="viewScope.entryTitle" value="\'Order ', r["o_orderpriority"], "'\"/>", mode,
                        '</on-entry>', F.when(k % 2 == 0, "<secured attributes='A'/>").otherwise(""), '<transition on="next" to="', to_next, '" condition="flowScope.total &gt;= ', k % 1000, '"/><transition on="back" to="', to_first, '"><evaluate expression="undoAction.run()"/></transition></view-state>')
        action = _written('<action-state id="s', k, '"><evaluate expression="payAction.save(flowScope.x)"/><transition to="', to_next, '"/><transition on="error"/></action-state>')
        decision = _written('<decision-state id="s', k, '"><if test="order.count == ', k % 7, '" then="', to_next, '" else="done"/></decision-state>')
        return F.when(r["o_orderstatus"] == "O", view).when(r["o_orderstatus"] == "F", action).otherwise(decision)

    flows_ = g.select("o_custkey", c("names")[0].alias("start"), F.array_join(F.transform("x", state), "\n").alias("states"))
    return flows_.select(c("o_custkey").alias("path"), _written('<?xml version="1.0"?>\n<flow start-state="', c("start"), '">\n<!-- <view-state id="ghost"/> -->', F.when(c("o_custkey") % 2 == 0, '<var name="wizardStep" class="S"/>').otherwise('<var name="x"/>'),
                                                                                 "\n", c("states"), '\n<end-state id="done" view="bye"/><transition on="cancel" to="done"/></flow>').alias("text"))


# The raw pages

_PAGE_TAGS = r"""raw AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g'), '(?is)(<(?:script|style)\b[^>]*>).*?(</(?:script|style)\s*>)', '\1\2', 'g') AS h FROM pages),
tok AS (SELECT page_id, unnest(regexp_extract_all(h, '<(/?[A-Za-z][\w:.-]*)(?:[^<>"'']|"[^"]*"|''[^'']*'')*>', 1)) AS name, unnest(regexp_extract_all(h, '<(/?[A-Za-z][\w:.-]*)(?:[^<>"'']|"[^"]*"|''[^'']*'')*>', 0)) AS token, generate_subscripts(regexp_extract_all(h, '<(/?[A-Za-z][\w:.-]*)(?:[^<>"'']|"[^"]*"|''[^'']*'')*>', 0), 1) AS pos FROM raw),
tg AS (SELECT page_id, pos, starts_with(name, '/') AS closing, lower(ltrim(name, '/')) AS tag, regexp_matches(token, '/\s*>$') AS void FROM tok),
s AS (SELECT *, sum(CASE WHEN closing THEN -1 ELSE 1 END) OVER (PARTITION BY page_id, tag ORDER BY pos) AS s FROM tg WHERE closing OR NOT void),
l AS (SELECT *, s + closing::INT - least(0, coalesce(min(s) OVER (PARTITION BY page_id, tag ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM s),
e AS (SELECT page_id, pos, tag, closing, coalesce(lead(CASE WHEN closing THEN pos END) OVER (PARTITION BY page_id, tag, level ORDER BY pos), pos) AS last FROM l WHERE level > 0),
el AS MATERIALIZED (SELECT page_id, pos, tag, last FROM e WHERE NOT closing UNION ALL SELECT page_id, pos, tag, pos FROM tg WHERE void AND NOT closing)"""


@query("s15_elements", f"WITH {_PAGE_TAGS} SELECT a.page_id, a.pos AS \"at\", a.tag, a.last, coalesce(max(b.pos) FILTER (b.tag IN ('ul', 'article', 'nav', 'head')), 0) AS section FROM el a LEFT JOIN el b ON a.page_id = b.page_id AND b.pos < a.pos AND a.pos < b.last GROUP BY a.page_id, a.pos, a.tag, a.last")
def _(t):
    """The SQL finds what encloses an element by comparing it with every other of its page."""
    found = elements.elements(t("pages"), "page_id", "html")
    around = F.greatest(*(elements.inside(x) for x in ("ul", "article", "nav", "head")))
    return found.select(F.col("key").alias("page_id"), F.col("at").cast("long").alias("at"), "tag", F.col("last").cast("long").alias("last"), F.coalesce(around, F.lit(0)).cast("long").alias("section"))


@query("s15_depths", f"WITH {_PAGE_TAGS}, d AS (SELECT a.page_id, a.pos, a.tag, count(b.pos) AS depth FROM el a LEFT JOIN el b ON a.page_id = b.page_id AND b.pos < a.pos AND a.pos < b.last GROUP BY a.page_id, a.pos, a.tag) SELECT page_id, tag, count(*) AS n, max(depth) AS deepest FROM d GROUP BY page_id, tag")
def _(t):
    g = elements.elements(t("pages"), "page_id", "html").groupBy(F.col("key").alias("page_id"), "tag")
    return g.agg(F.count("*").alias("n"), F.max(F.col("depth").cast("long")).alias("deepest"))


# JSP pages


def _jsp(t):
    pages = cut(jsp_pages(t), "jsp")
    return pages, cut(elements.elements(pages), "elements"), cut(elements.tags(pages), "tags")


@query("s15_forms", "SELECT c_custkey AS page, unnest([0, 1, 2]) AS form, unnest(['/save/' || c_custkey, 'placeholder/find', '']) AS action, unnest(['POST', 'GET', 'GET']) AS method, unnest([NULL, NULL, 'text/plain']) AS enctype FROM customer")
def _(t):
    return elements.forms(elements.elements(jsp_pages(t))).select(F.col("key").alias("page"), "form", "action", "method", "enctype")


_FIELDS = """SELECT o_custkey AS page, '/save/' || o_custkey AS action, 'o' || o_orderkey AS name, CASE WHEN o_orderstatus = 'F' THEN 'textarea' ELSE 'number' END AS type, o_orderkey % 3 = 0 AS required, false AS read_only,
  CASE WHEN o_orderkey % 4 < 3 THEN 'Order ' || o_orderpriority END AS label, CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey % 90 END AS max_length, CASE WHEN o_orderstatus <> 'F' THEN 'a < b > ' || o_orderkey END AS default_value, NULL AS options FROM orders
UNION ALL SELECT c_custkey, 'placeholder/find', 'status', 'select', false, false, 'Status', NULL, NULL, 'O=Open*,Done=Done' FROM customer
UNION ALL SELECT c_custkey, '', 'total', 'input', false, true, 'Total', NULL, NULL, NULL FROM customer"""


@query("s15_fields", _FIELDS)
def _(t):
    _, found, all_tags = _jsp(t)
    shown = F.array_join(F.transform("options", lambda o: F.concat(o["value"], F.lit("="), o["label"], F.when(o["is_default"], "*").otherwise(""))), ",")
    own = elements.fields(found, all_tags).join(elements.forms(found).select("key", F.col("at").alias("form_at"), "action"), ["key", "form_at"])
    return own.select(F.col("key").alias("page"), "action", "name", "type", "required", "read_only", "label", F.col("max_length").cast("long").alias("max_length"), "default_value", shown.alias("options"))


@query("s15_submits", "SELECT c_custkey AS page, unnest(['submit', 'button']) AS type, unnest([NULL, 'more']) AS name, unnest(['Save', 'More now']) AS value FROM customer")
def _(t):
    _, found, all_tags = _jsp(t)
    return elements.submits(found, all_tags).select(F.col("key").alias("page"), "type", "name", "value")


@query("s15_tables", """SELECT c_custkey AS page, unnest(['t' || c_custkey, 'displaytable_0']) AS name, unnest(['orders', 'list' || c_nationkey]) AS source, true AS paginated,
unnest(['Key:key:number:true,Date::text:false', 'a:a:text:true,B::text:false']) AS columns FROM customer""")
def _(t):
    _, found, all_tags = _jsp(t)
    shown = F.array_join(F.transform("columns", lambda x: F.concat_ws(":", x["header"], F.coalesce(x["field"], F.lit("")), x["type"], x["sortable"].cast("string"))), ",")
    return elements.data_tables(found, all_tags).select(F.col("key").alias("page"), "name", "source", "paginated", shown.alias("columns"))


@query("s15_bindings", """SELECT c_custkey AS page, unnest(['input', 'select', 'checkbox']) AS type, unnest(['address.street' || c_nationkey, 'kind', 'free']) AS path, unnest(['street' || c_nationkey, 'kind', 'free']) AS field,
unnest(['customer' || c_nationkey, 'customer' || c_nationkey, NULL]) AS model, unnest([true, false, false]) AS required FROM customer""")
def _(t):
    pages = jsp_pages(t)
    found = elements.elements(pages, clean=elements.without_code(F.col("text"), None))
    return elements.bindings(found).select(F.col("key").alias("page"), "type", "path", "field", "model", "required")


@query("s15_page_parts", """SELECT c_custkey AS page, unnest(['include', 'include', 'taglib', 'taglib', 'tag', 'tag', 'tag', 'tag', 'tag', 'expression', 'expression', 'encoding']) AS part,
unnest(['/head' || c_nationkey || '.jsp', '/menu.jsp', 'form', 'c', 'form', 'form', 'form', 'form', 'c', 'ctx', 'customer.id > 0', 'UTF-8']) AS name,
unnest(['directive', 'action', 'http://forms/' || c_nationkey, 'http://core', 'form', 'input', 'select', 'checkbox', 'if', '', '', '']) AS value FROM customer""")
def _(t):
    return elements.page_parts(jsp_pages(t)).select(F.col("key").alias("page"), "part", "name", "value")


# Menus

_MENU = """m AS (SELECT r_regionkey AS region, r_name AS label, '' AS url, NULL AS parent_label, 1 AS level, 'ADMIN' AS roles, '' AS flow, NULL AS view, NULL AS mode, NULL AS source FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)
UNION ALL SELECT n_regionkey, n_name, 'nation.html', r_name, 2, '', 'nation', NULL, NULL, NULL FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT n_regionkey, c_name, 'flow' || c_custkey || '.html?pageSelect=' || v || CASE WHEN c_custkey % 5 = 0 THEN '&mode=EDIT' ELSE '' END, n_name, 3, 'ALL,R' || c_custkey % 4, 'flow' || c_custkey, v,
  CASE WHEN c_custkey % 5 = 0 THEN 'edit' WHEN c_custkey % 3 = 0 THEN 'inquiry' WHEN c_custkey % 3 = 1 THEN 'create' END, CASE WHEN c_custkey % 5 = 0 THEN 'url-param' WHEN c_custkey % 3 < 2 THEN 'pageSelect-suffix' END
  FROM (SELECT *, CASE c_custkey % 3 WHEN 0 THEN 'orderInquiry' WHEN 1 THEN 'orderWizardStart' ELSE 'order' END AS v FROM customer) JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 7 <> 0)"""


def _menu(t):
    files = cut(menu_files(t), "menus")
    clean = F.regexp_replace("text", r"(?s)<!--.*?-->", " ")
    return elements.menu_entries(cut(elements.elements(files, clean=clean), "elements"), elements.tags(files, clean=clean))


@query("s17_menu_tree", f"WITH {_MENU} SELECT * FROM m")
def _(t):
    return _menu(t).select(F.col("key").alias("region"), "label", "url", "parent_label", F.col("level").cast("int").alias("level"), F.array_join("roles", ",").alias("roles"), "flow", "view", "mode", "source")


# Flows

_STATES = """st AS (SELECT o_custkey AS flow, o_orderkey AS k, 's' || o_orderkey || CASE WHEN o_orderstatus = 'O' AND o_orderkey % 4 = 2 THEN 'Wizard' ELSE '' END AS state, o_orderstatus AS status, o_orderpriority AS pri,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, count(*) OVER (PARTITION BY o_custkey) AS total FROM orders),
mv AS (SELECT a.*, b.state AS nxt, f.state AS fst FROM st a JOIN st b ON a.flow = b.flow AND b.n = a.n % a.total + 1 JOIN st f ON a.flow = f.flow AND f.n = 1)"""


def _flow_elements(t, **how):
    return flows.flow_elements(cut(flow_files(t), "flows"), **how)


def _moves(t):
    return flows.flow_transitions(_flow_elements(t, only=flows.MOVES, once=True))


def _flow(t):
    found = _flow_elements(t)
    states = cut(flows.flow_states(found), "states")
    return found, states, cut(flows.flow_transitions(found), "transitions"), flows.flow_definitions(found)


@query("s16_states", f"""WITH {_STATES} SELECT flow, state, CASE status WHEN 'O' THEN 'view-state' WHEN 'F' THEN 'action-state' ELSE 'decision-state' END AS kind, CASE WHEN status = 'O' THEN CASE WHEN k % 3 = 0 THEN 'page' || flow || '.jsp' ELSE state END END AS view, status = 'O' AND k % 2 = 0 AS secured,
  CASE WHEN status = 'O' THEN CASE k % 4 WHEN 0 THEN 3 WHEN 1 THEN 3 ELSE 2 END ELSE 0 END AS n_entry FROM st UNION ALL SELECT DISTINCT flow, 'done', 'end-state', 'bye', false, 0 FROM st""")
def _(t):
    states = flows.flow_states(_flow_elements(t))
    return states.select(F.col("key").alias("flow"), "state", "kind", "view", "secured", F.size("on_entry").alias("n_entry"))


@query("s16_transitions", f"""WITH {_STATES} SELECT flow, state AS source, 'next' AS event, nxt AS target, 'flowScope.total >= ' || k % 1000 AS condition, 'greaterThanOrEquals' AS operator, 'flowScope.total' AS "left", CAST(k % 1000 AS VARCHAR) AS "right", 'total,flowScope' AS variables, 'Condition based on: total, flowScope' AS description FROM mv WHERE status = 'O'
UNION ALL SELECT flow, state, 'back', fst, NULL, NULL, NULL, NULL, NULL, NULL FROM mv WHERE status = 'O' UNION ALL SELECT flow, state, 'default', nxt, NULL, NULL, NULL, NULL, NULL, NULL FROM mv WHERE status = 'F'
UNION ALL SELECT flow, state, 'then', nxt, 'order.count == ' || k % 7, 'equals', 'order.count', CAST(k % 7 AS VARCHAR), 'order,count', 'When order.count equals ' || k % 7 FROM mv WHERE status NOT IN ('O', 'F')
UNION ALL SELECT flow, state, 'else', 'done', '!(order.count == ' || k % 7 || ')', 'equals', '!(order.count', k % 7 || ')', 'order,count', 'When !(order.count equals ' || k % 7 || ')' FROM mv WHERE status NOT IN ('O', 'F')
UNION ALL SELECT DISTINCT flow, 'global', 'cancel', 'done', NULL, NULL, NULL, NULL, NULL, NULL FROM st""")
def _(t):
    return _moves(t).select(F.col("key").alias("flow"), "source", "event", "target", "condition", "parts.operator", "parts.left", "parts.right", F.array_join("parts.variables", ",").alias("variables"), "parts.description")


@query("s16_state_graph", f"""WITH {_STATES}, e AS (SELECT flow, state AS source, nxt AS target, CASE status WHEN 'O' THEN 'next' WHEN 'F' THEN 'default' ELSE 'then' END AS event FROM mv UNION ALL SELECT flow, state, fst, 'back' FROM mv WHERE status = 'O' UNION ALL SELECT flow, state, 'done', 'else' FROM mv WHERE status NOT IN ('O', 'F'))
SELECT flow, source, target, string_agg(DISTINCT event, ',' ORDER BY event) AS events FROM e GROUP BY flow, source, target""")
def _(t):
    return flows.state_graph(_moves(t)).select(F.col("key").alias("flow"), "source", "target", F.array_join("events", ",").alias("events"))


_SCREENS = f"""{_STATES}, sc AS (SELECT flow, state AS screen, k, 'Order ' || pri AS title, CASE WHEN k % 4 = 2 THEN 'wizard' WHEN k % 3 = 0 THEN 'unknown' ELSE 'results' END AS kind, CASE WHEN k % 3 = 0 THEN 'page' || flow || '.jsp' ELSE state || 'Entry.jsp,' || state || 'Results.jsp' END AS pages, nxt || ',' || fst AS targets,
  CASE k % 4 WHEN 0 THEN 'maintenance' WHEN 1 THEN 'inquiry' WHEN 2 THEN 'create' END AS mode, CASE k % 4 WHEN 0 THEN 'on-entry-action' WHEN 1 THEN 'on-entry-action' WHEN 2 THEN 'naming-pattern' ELSE CASE WHEN flow % 2 = 0 THEN 'flow-variable' END END AS mode_source,
  CASE WHEN flow % 2 = 0 THEN 'create,edit' ELSE '' END || CASE k % 4 WHEN 0 THEN CASE WHEN flow % 2 = 0 THEN ',maintenance' ELSE 'maintenance' END WHEN 1 THEN CASE WHEN flow % 2 = 0 THEN ',inquiry' ELSE 'inquiry' END WHEN 2 THEN CASE WHEN flow % 2 = 0 THEN '' ELSE 'create' END ELSE '' END AS supported FROM mv WHERE status = 'O')"""


def _screens(t):
    found, states, moves, defined = _flow(t)
    return cut(flows.screens(found, states, moves, defined), "screens"), moves, defined


@query("s16_screens", f"WITH {_SCREENS} SELECT flow, screen, title, kind, pages, targets, mode, mode_source, supported, 'orderAction' AS action_class, 'load,run' AS methods FROM sc")
def _(t):
    every = _flow_elements(t)
    moves = flows.flow_transitions(every)
    found = flows.screens(every, flows.flow_states(every), moves, flows.flow_definitions(every))
    return found.select(F.col("key").alias("flow"), "screen", "title", "kind", F.array_join("pages", ",").alias("pages"), F.array_join("targets", ",").alias("targets"), "mode", "mode_source", F.array_join("supported_modes", ",").alias("supported"),
                        "action_class", F.array_join("action_methods", ",").alias("methods"))


@query("s16_screen_conditions", f"""WITH {_STATES}, c AS (SELECT *, CASE status WHEN 'O' THEN 'flowScope.total >= ' || k % 1000 WHEN 'F' THEN NULL ELSE 'order.count == ' || k % 7 END AS cond FROM st)
SELECT a.flow, a.state, a.n - 1 AS steps, coalesce(string_agg(b.cond, ' ; ' ORDER BY b.n), '') AS conditions FROM c a LEFT JOIN c b ON a.flow = b.flow AND b.n < a.n WHERE a.status = 'O' GROUP BY a.flow, a.state, a.n""")
def _(t):
    """The walk through the flows, which are all cycles, up to each screen."""
    found, moves, defined = _screens(t)
    met = flows.screen_conditions(defined, moves)
    return met.join(found.select("key", F.col("screen").alias("state")), ["key", "state"]).select(F.col("key").alias("flow"), "state", F.col("steps").cast("long").alias("steps"), F.array_join("conditions", " ; ").alias("conditions"))


# Named retrievals over them


@query("t12_screen_fields", f"""WITH {_SCREENS}, f AS ({_FIELDS}) SELECT sc.flow, sc.screen, f.action, f.name, f.type, f.required, f.label FROM sc JOIN f ON sc.flow = f.page WHERE sc.k % 3 = 0""")
def _(t):
    _, found, all_tags = _jsp(t)
    shown, _, _ = _screens(t)
    own = elements.fields(found, all_tags).join(elements.forms(found).select("key", F.col("at").alias("form_at"), "action"), ["key", "form_at"])
    pages = own.select(F.concat(F.lit("page"), F.col("key").cast("string"), F.lit(".jsp")).alias("page"), "action", "name", "type", "required", "label")
    return retrieval.screen_fields(shown, pages).select(F.col("key").alias("flow"), "screen", "action", "name", "type", "required", "label")


@query("t12_submenu_screens", f"WITH {_SCREENS}, {_MENU} SELECT m.parent_label AS menu, m.label, m.mode, count(sc.screen) AS n_screens, count(sc.screen) FILTER (sc.mode = 'maintenance') AS n_maintenance FROM m LEFT JOIN sc ON m.flow = 'flow' || sc.flow WHERE m.level = 3 GROUP BY m.region, m.parent_label, m.label, m.mode")
def _(t):
    shown, _, _ = _screens(t)
    shown = shown.withColumn("flow", F.concat(F.lit("flow"), F.col("key").cast("string")))
    return retrieval.submenu_screens(_menu(t).where("level = 3"), shown).select(F.col("parent_label").alias("menu"), "label", "mode", "n_screens", "n_maintenance")


@query("t12_screen_detail", f"""WITH {_SCREENS}, f AS ({_FIELDS}), n AS (SELECT page, count(*) AS n, count(*) FILTER (required) AS r FROM f GROUP BY page)
SELECT sc.flow, sc.screen, sc.title, CASE WHEN sc.k % 3 = 0 THEN coalesce(n.n, 0) ELSE 0 END AS n_fields, CASE WHEN sc.k % 3 = 0 THEN coalesce(n.r, 0) ELSE 0 END AS n_required, CASE WHEN sc.k % 3 = 0 THEN 'displaytable_0,t' || sc.flow ELSE '' END AS tables, 'back,next' AS actions FROM sc LEFT JOIN n ON sc.flow = n.page""")
def _(t):
    _, found, all_tags = _jsp(t)
    shown, moves, _ = _screens(t)
    page = F.concat(F.lit("page"), F.col("key").cast("string"), F.lit(".jsp")).alias("page")
    d = retrieval.screen_detail(shown, elements.fields(found, all_tags).select(page, "name", "required"), elements.data_tables(found, all_tags).select(page, "name"), moves)
    return d.select(F.col("key").alias("flow"), "screen", "title", "n_fields", "n_required", F.array_join("tables", ",").alias("tables"), F.array_join("actions", ",").alias("actions"))
