"""Queries of the rules on names, paths and source text.

The tables hold no source code, so every part gets names, kinds, paths and texts by rule from its key:
value number ``p_partkey`` modulo the number of values. The lists reach each outcome of the rules. The SQL
states the rules anew, or the outcome of each value as read from their definition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from codelattice.functions import code_text, ids, ladders, words
from codelattice.operators import classify, detect, reports
from codelattice.plans.table_queries import query
from codelattice.sources import parsers

QUERIES, ORACLES = {}, {}  # these register with the table queries

NAMES = (
    "UserAction", "OrderController", "customerDao", "OrderRepository", "PricingService", "ReportBuilder", "AddressValidator", "Customer", "ActionItem", "ServiceLocator", "StringUtils", "DateHelper", "MoneyFormatter",
    "AppConstants", "BaseDialog", "AbstractEntity", "CommonErrors", "ErrorHandler", "GatewayAdapter", "OrderMapper", "MeterConfig", "ContactSurvey", "LegalEntityProvider", "AuditLogger", "loginSession", "billingInvoice",
    "adminConsole", "statsExport", "searchFilter", "smsAlert", "userProfile", "settingOption", "wizardStep", "webhookSync", "saveData", "orderTests", "DataBaseLoader", "findAll", "createOrder", "updateOrder", "removeOrder",
    "checkOrder", "convertOrder", "printOrder", "customerEntry", "orderResults", "orderInquiry", "orderLookup", "orderMaintenance", "SpecRunner", "XMLApiUIThing",
)
KINDS = ("JSPPage", "JSP", "WebFlowDefinition", "FlowState", "JavaClass", "Class", "SpringController", "SpringService", "RestEndpoint", "SQLTable", "Entity", "OrderDTO", "JavaField", "JavaMethod", "Function", "HtmlView",
         "UserDao", "MapperType", "JSPForm", "FlowAction")
PATHS = (
    "/r/src/main/java/persistence/A.java", "/r/web/app/index.jsp", "/r/config/webflow/order.xml", "/r/flows/order-flow.xml", "/r/src/ui/Button.tsx", "/r/app/frontend/main.ts", "/r/srv/web/app.js", "/r/src/test/java/ATest.java",
    "/r/lib/spec/a.rb", "/r/src/main/resources/application.yml", "/r/settings.py", "/r/conf/db.json", "/r/src/main/data/schema.json", "/r/core/engine.go", "/r/app/actions/save.java", "/r/app/controller/x.java",
    "/r/app/dao/x.java", "/r/app/model/x.java", "/r/pkg-test/x.go", "/r/src/__tests__/a.js", "/r/static/assets/logo.svg", "/r/webapp/x.css", "/r/lib/a.spec.ts",
)


def pick(values: Sequence[str], key: str = "p_partkey") -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.col(key) % len(values) + 1).cast("int"))


def sql_pick(values: Sequence[str], key: str = "p_partkey") -> str:
    listed = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"([{listed}])[CAST({key} % {len(values)} + 1 AS INTEGER)]"


def _case(value: str, rules: Sequence[tuple[str, str]], default: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({value}, '{p}') THEN '{x}'" for p, x in rules) + f" ELSE {default} END"


_NAME, _KIND, _PATH = sql_pick(NAMES), sql_pick(KINDS), sql_pick(PATHS)


def _code(t):
    return t("part").select("p_partkey", pick(NAMES).alias("name"), pick(KINDS).alias("kind"), pick(PATHS).alias("path"))


_CODE = f"c AS (SELECT p_partkey, {_NAME} AS name, lower({_NAME}) AS n, {_KIND} AS kind, lower({_KIND}) AS k, {_PATH} AS path, lower({_PATH}) AS p FROM part)"


@query("f_category_ladder", f"WITH {_CODE} SELECT p_partkey, " + _case("n || ' ' || k || ' ' || p", (
    ("auth|login|logout|session|oauth|sso|credential", "authentication"), ("user|profile|account|member|customer|register", "user_management"), ("payment|billing|invoice|subscription|checkout|cart", "payment"),
    ("admin|manage|dashboard|console", "admin"), ("report|analytics|stats|metrics|export", "reporting"), ("search|filter|find|query|lookup", "search"), ("notify|alert|email|sms|push|message", "notification"),
    ("config|setting|preference|option", "configuration"), ("workflow|process|flow|step|wizard", "workflow"), ("integrat|api|external|webhook|sync", "integration"), ("create|update|delete|edit|save|load|data", "data_management")),
    "'other'") + " AS category FROM c")
def _(t):
    return _code(t).select("p_partkey", ladders.business_category(F.col("name"), F.col("kind"), F.col("path")).alias("category"))


@query("f_operation_type", f"WITH {_CODE} SELECT p_partkey, " + _case("n", (
    ("get|find|search|load|read", "read"), ("save|create|insert|add|persist", "write"), ("update|modify|edit", "write"), ("delete|remove", "write"), ("validate|check|verify", "validate"),
    ("build|convert|transform|map", "transform")), "NULL") + " AS operation FROM c")
def _(t):
    return _code(t).select("p_partkey", ladders.operation_type(F.col("name")).alias("operation"))


@query("f_triggers", f"""WITH {_CODE}, x AS (SELECT p_partkey, list_filter([CASE WHEN regexp_matches(n, 'save|create|add') THEN 'save' END, CASE WHEN regexp_matches(n, 'save|create|add') THEN 'create' END,
CASE WHEN regexp_matches(n, 'update|edit|modify') THEN 'update' END, CASE WHEN regexp_matches(n, 'delete|remove') THEN 'delete' END, CASE WHEN regexp_matches(n, 'validate|check') THEN 'validate' END], lambda v: v IS NOT NULL) AS t FROM c)
SELECT p_partkey, CASE WHEN len(t) = 0 THEN ['save', 'update'] ELSE t END AS triggers FROM x""")
def _(t):
    return _code(t).select("p_partkey", ladders.triggers(F.col("name")).alias("triggers"))


@query("f_screen_type", f"WITH {_CODE} SELECT p_partkey, " + _case("n", [(x, x) for x in ("wizard", "search", "lookup", "inquiry", "results", "maintenance", "entry")], "'unknown'")
       + " AS screen, trim(regexp_replace(upper(name[1]) || name[2:], '([A-Z])', ' \\1', 'g')) AS title FROM c")
def _(t):
    return _code(t).select("p_partkey", ladders.screen_type(F.col("name")).alias("screen"), ladders.humanised(F.col("name")).alias("title"))


@query("f_layer_variants", f"""WITH {_CODE} SELECT p_partkey,
CASE WHEN contains(k, 'jsp') THEN 'UI' WHEN regexp_matches(k, 'webflow|flowstate') THEN 'Flow' WHEN regexp_matches(n, '(action|controller)$') THEN 'Controller' WHEN regexp_matches(n, 'dao|repository') THEN 'DAO'
 WHEN regexp_matches(n, 'service|builder|validator') THEN 'Service' WHEN k = 'javaclass' AND NOT contains(n, 'action') AND NOT contains(n, 'service') THEN 'Entity' ELSE 'Unknown' END AS flow,
CASE WHEN kind = 'JSPPage' THEN 'UI' WHEN kind IN ('WebFlowDefinition', 'FlowState') THEN 'Flow' WHEN regexp_matches(n, '(action|controller)$') THEN 'Controller' WHEN regexp_matches(n, 'dao|repository') THEN 'DAO'
 WHEN regexp_matches(n, 'service|builder') THEN 'Service' ELSE 'Unknown' END AS chain,
CASE WHEN contains(k, 'jsp') THEN 'ui' WHEN regexp_matches(k, 'webflow|flowdefinition') THEN 'flow' WHEN regexp_matches(n, 'action|controller') THEN 'controller' WHEN regexp_matches(n, 'dao|repository') THEN 'data' ELSE 'service' END AS context,
CASE WHEN kind IN ('JSPPage', 'JSP') THEN 'ui' WHEN kind = 'WebFlowDefinition' THEN 'flow' WHEN regexp_matches(n, '(action|controller)$') THEN 'controller' WHEN regexp_matches(n, 'dao|repository') THEN 'data'
 WHEN regexp_matches(n, 'service|builder|validator') THEN 'service' ELSE 'entity' END AS implementation,
CASE WHEN regexp_matches(k, 'jsp|html|view|webflow|flowdefinition|flowstate') THEN 'presentation' WHEN regexp_matches(k, 'controller|action') OR contains(n, 'action') THEN 'controller' WHEN contains(k, 'service') OR contains(n, 'service') THEN 'service'
 WHEN regexp_matches(n, 'validator|builder') THEN 'service' WHEN regexp_matches(k, 'dao|repository|mapper|sqltable|sqlview') OR regexp_matches(n, 'dao|repository') THEN 'data' ELSE 'service' END AS explore FROM c""")
def _(t):
    return _code(t).select("p_partkey", *(ladders.layer(F.col("kind"), F.col("name"), v).alias(v) for v in ladders.LAYERS))


@query("f_file_category", f"""WITH {_CODE} SELECT p_partkey, CASE WHEN ends_with(p, '.jsp') THEN 'jsp' WHEN contains(p, 'webflow') OR (ends_with(p, '.xml') AND contains(p, 'flow')) THEN 'webflow'
WHEN regexp_matches(p, '[.](tsx|jsx|vue|html|css|scss)') THEN 'frontend' WHEN regexp_matches(p, '/(frontend|ui|web)/') AND regexp_matches(p, '[.](ts|js)$') THEN 'frontend' WHEN regexp_matches(p, 'test|spec') THEN 'test'
WHEN regexp_matches(p, 'config|application[.]|settings|properties') THEN 'config' WHEN regexp_matches(p, '[.](yaml|yml|properties|xml|json)$') AND NOT contains(p, 'src/main') THEN 'config' ELSE 'backend' END AS category FROM c""")
def _(t):
    return _code(t).select("p_partkey", ladders.file_category(F.col("path")).alias("category"))


@query("f_component_category", f"""WITH {_CODE} SELECT p_partkey, CASE WHEN k = 'javafield' THEN CASE WHEN regexp_matches(n, 'service|repository|dao|validator|builder') THEN 'service' ELSE 'other' END WHEN k = 'javamethod' THEN 'other'
WHEN k IN ('jsppage', 'jspform', 'jspinclude', 'jsptaglib') OR ends_with(p, '.jsp') THEN 'jsp' WHEN contains(k, 'flow') THEN 'webflow' WHEN k IN ('sqltable', 'sqlview', 'sqlcolumn') THEN 'database'
WHEN contains(k, 'controller') OR contains(n, 'controller') THEN 'controller' WHEN ends_with(n, 'action') AND k IN ('class', 'javaclass', 'springservice') THEN 'controller' WHEN contains(p, '/actions/') OR contains(p, '/controller/') THEN 'controller'
WHEN regexp_matches(k, 'repository|dao') OR regexp_matches(n, 'repository|dao|mapper') OR regexp_matches(p, '/persistence/|/dao/|/repository/') THEN 'repository' WHEN k = 'springservice' AND NOT ends_with(n, 'action') THEN 'service'
WHEN contains(k, 'service') THEN 'service' WHEN contains(n, 'service') AND NOT ends_with(n, 'action') THEN 'service' WHEN regexp_matches(k, 'entity|model|dto') OR regexp_matches(p, '/model/|/dto/|/entity/') THEN 'data_model'
WHEN regexp_matches(n, 'validator|builder') THEN 'service' WHEN regexp_matches(k, 'endpoint|api|rest') THEN 'api' WHEN regexp_matches(n, 'test|spec') THEN 'test' ELSE 'other' END AS category FROM c""")
def _(t):
    return _code(t).select("p_partkey", ladders.component_category(F.col("kind"), F.col("name"), F.col("path")).alias("category"))


@query("f_source_type", f"""WITH {_CODE} SELECT p_partkey, CASE WHEN regexp_matches(p, '/src/test/|/test/|/__tests__/|[.]test[.]|[.]spec[.]|-test/') THEN 'test' WHEN regexp_matches(p, '/resources/|/assets/|/webapp/') THEN 'resource'
WHEN regexp_matches(p, '/src/main/|/src/|/main/') THEN 'main' ELSE 'other' END AS source FROM c""")
def _(t):
    return _code(t).select("p_partkey", ids.source_type(F.col("path")).alias("source"))


@query("f_title_words", f"""WITH {_CODE}, s AS (SELECT p_partkey, string_split(regexp_replace(regexp_replace(name, '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), ' ') AS w FROM c)
SELECT p_partkey, array_to_string(list_transform(w, lambda x: CASE WHEN lower(x) IN ('edi', 'duns', 'api', 'ui', 'csr', 'xml') THEN upper(x) ELSE upper(x[1]) || lower(x[2:]) END), ' ') AS title FROM s""")
def _(t):
    return _code(t).select("p_partkey", ladders.camel_title(F.col("name")).alias("title"))


@query("d_shared_components", f"""WITH {_CODE} SELECT p_partkey, CASE WHEN contains(n, 'util') THEN 'utility' WHEN contains(n, 'helper') THEN 'helper' WHEN contains(n, 'validator') OR contains(n, 'validation') THEN 'validator' WHEN contains(n, 'converter') THEN 'converter'
WHEN contains(n, 'formatter') THEN 'formatter' WHEN contains(n, 'constant') THEN 'constants' WHEN starts_with(name, 'Base') THEN 'base' WHEN starts_with(name, 'Abstract') THEN 'abstract' ELSE 'utility' END AS type,
list_filter([CASE WHEN regexp_matches(n || ' ' || p, 'point|poi|location|coordinate') THEN 'point' END, CASE WHEN regexp_matches(n || ' ' || p, 'legalentity|legal|entity|party|company') THEN 'legalEntity' END,
 CASE WHEN regexp_matches(n || ' ' || p, 'meter|station|measurement') THEN 'meter' END, CASE WHEN regexp_matches(n || ' ' || p, 'contact|address|phone|email') THEN 'contact' END, CASE WHEN regexp_matches(n || ' ' || p, 'survey|questionnaire|form') THEN 'survey' END,
 CASE WHEN regexp_matches(n || ' ' || p, 'edi|trading|partner|dataset') THEN 'edi' END, CASE WHEN regexp_matches(n || ' ' || p, 'farmtap|farm|tap|region') THEN 'farmtap' END], lambda v: v IS NOT NULL) AS domains,
regexp_matches(n, 'logger|logging|audit|security|auth|cache|transaction|exception|error|message|notification|email|validation') AS cross_cutting
FROM c WHERE regexp_matches(name, '(?i)util(s)?$|helper$|converter$|formatter$|constants?$|config(uration)?$|common|builder$|factory$|provider$|adapter$|handler$|wrapper$') OR regexp_matches(name, '^Base[A-Z]|^Abstract[A-Z]')""")
def _(t):
    return _code(t).select("p_partkey", classify.shared_component(F.col("name"), F.col("path")).alias("s")).where("s is not null").select("p_partkey", "s.*")


@query("a25_coverage_by_inferred_path", """WITH p AS (SELECT page_id, regexp_extract(url, '://([^?#]*)', 1) AS src FROM pages), s AS (SELECT DISTINCT src FROM p WHERE length(src) % 2 = 0), f AS (SELECT src || '.ts' AS path FROM p)
SELECT count(*) AS files, count(x.path) AS tested, round(coalesce(avg(CASE WHEN x.path IS NULL THEN 0.0 ELSE 1.0 END), 0), 9) AS ratio FROM f LEFT JOIN (SELECT src || '.ts' AS path FROM s) x ON f.path = x.path""")
def _(t):
    """Every page's address is a source file; those of even length have a test file beside them."""
    at = t("pages").select(F.regexp_extract("url", "://([^?#]*)", 1).alias("at"))
    tests = at.where("length(at) % 2 = 0").select(detect.tested_path(F.concat("at", F.lit(".test.ts"))).alias("path")).distinct().withColumn("has", F.lit(True))
    j = at.select(F.concat("at", F.lit(".ts")).alias("path")).join(tests, "path", "left")
    return j.agg(F.count("*").alias("files"), F.count("has").alias("tested"), F.round(reports.ratio(F.col("has"), 0.0), 9).alias("ratio"))


# Words and questions

_ASKED = ("What class holds this? ", "How does it work? ", "Where is the CartService? ", "It depends on user_name. ", "Which design fits? ", "Tell me 'the story' again. ")
_TYPES = ("structural", "functional", "locational", "dependency", "pattern", "general")


@query("f_question_type", f"SELECT p_partkey, {sql_pick(_TYPES)} AS question, p_name AS subject FROM part")
def _(t):
    """The question is put by rule; the part's name, which holds none of the phrases, follows."""
    return t("part").select("p_partkey", words.question_type(F.concat(pick(_ASKED), "p_name")).alias("question"), F.col("p_name").alias("subject"))


_KEYS = ("class,holds", "work", "CartService", "depends,user_name", "design,fits", "Tell,story,again,the story")


@query("f_question_keywords", f"SELECT p_partkey, {sql_pick(_KEYS)} AS keywords FROM part")
def _(t):
    return t("part").select("p_partkey", F.array_join(words.question_keywords(pick(_ASKED)), ",").alias("keywords"))


@query("f_keyword_extraction", r"""WITH w AS (SELECT item_id, list_filter(string_split_regex(lower(text), '\s+'), lambda x: length(x) > 3 AND x NOT IN ('with', 'from', 'that', 'this', 'have', 'will', 'should', 'would', 'could', 'need', 'want')) AS w FROM benchmark)
SELECT item_id, list_slice(list_filter(w, lambda x, i: list_position(w, x) = i), 1, 10) AS keys FROM w""")
def _(t):
    return t("benchmark").select("item_id", words.keywords(F.col("text")).alias("keys"))


@query("f_keywords", r"""WITH w AS (SELECT conv_id, turn, list_filter(string_split_regex(lower(text), '\s+'), lambda x: length(x) > 3 AND x NOT IN ('with', 'from', 'that', 'this', 'have', 'will', 'should', 'would', 'could', 'need', 'want')) AS w FROM conversations)
SELECT conv_id, turn, list_slice(list_filter(w, lambda x, i: list_position(w, x) = i), 1, 5) AS keys FROM w""")
def _(t):
    return t("conversations").select("conv_id", "turn", words.keywords(F.col("text"), 5).alias("keys"))


_PHRASES = ("Legal Entity Maintenance", "contract search results", "Point", "create update", "Export Invoice Lines")


@query("f_compound", f"SELECT p_partkey, {sql_pick(('legalentity', 'contract', 'point', '', 'invoicelines'))} AS subject, {sql_pick(('maintenance', 'search,results', '', 'create,update', 'export'))} AS actions FROM part")
def _(t):
    return t("part").select("p_partkey", words.compound(F.split(pick(_PHRASES), " ")).alias("c")).select("p_partkey", "c.subject", F.array_join("c.actions", ",").alias("actions"))


# Paths and source text

_ROUTES = ("/users/{id}/orders/{orderId}", "/users/:id", "/blog/<slug>", "/docs/[...path]", "/plain")


@query("f_path_parameters", f"SELECT p_partkey, {sql_pick(('id,orderId', 'id', 'slug', 'path', ''))} AS parameters FROM part")
def _(t):
    return t("part").select("p_partkey", F.array_join(ids.path_parameters(pick(_ROUTES)), ",").alias("parameters"))


_SIGNATURES = ("f(a, b)", "f()", "Map<K, V> g(Map<String, List<Integer>> m, int[] x, T<A, B> y)", "h( )", "value", "k(x: [int, int], y)")


@query("f_parameter_count", f"SELECT p_partkey, CAST({sql_pick(('2', '0', '3', '0', '0', '2'))} AS INTEGER) AS n FROM part")
def _(t):
    return t("part").select("p_partkey", code_text.parameter_count(pick(_SIGNATURES)).alias("n"))


_STATEMENTS = (
    "SELECT o.id, c.name AS customer FROM orders o, clients x JOIN customer c ON o.c = c.id JOIN orders p ON 1 = 1", "select distinct * from part", "INSERT INTO log (a, b) VALUES (1, 2)", "INSERT INTO log SELECT 1",
    "UPDATE part SET p_size = 1, p_name = 'x' WHERE p_partkey = 3", "DELETE FROM orders WHERE 1 = 1", "MERGE INTO target t USING source s ON (t.id = s.id)", "CALL refresh_totals(1)", "alter table x",
)
_PARSED = (
    "SELECT|orders|orders,clients,customer|o.id,customer", "SELECT|part|part|", "INSERT|log|log|a,b", "SELECT||", "UPDATE|part|part|p_size,p_name", "DELETE|orders|orders|", "MERGE|target|target,source|", "CALL|||", "UNKNOWN|||",
)
_PARSED = tuple("INSERT|log|log|" if x == "SELECT||" else x for x in _PARSED)


@query("f_sql_statement", f"SELECT p_partkey, {sql_pick(_PARSED)} AS parsed FROM part")
def _(t):
    s = t("part").select("p_partkey", code_text.sql_statement(pick(_STATEMENTS)).alias("s"))
    return s.select("p_partkey", F.concat_ws("|", "s.kind", "s.main_table", F.array_join("s.tables", ","), F.array_join("s.columns", ",")).alias("parsed"))


_CONDITIONS = ("order == null", "customer != null && x", "count >= 10", "!approved", "amount > 1000.5", "status == 'OPEN'", "isReady(x)", "a < b")
_GUARDS = ("order is_null  null_check", "customer not_null  null_check", "count greater_than_or_equals 10 bounds_check", "approved equals false state_check", "amount greater_than 1000 bounds_check", "none", "none", "none")
_BUSINESS = ("0.0  custom ", "0.0  custom ", "0.6 count greater_than_or_equals 10", "0.6  custom ", "0.6 amount greater_than 1000.5", "0.6 status equals OPEN", "0.0  custom ", "0.0  custom ")


@query("f_guard", f"SELECT p_partkey, {sql_pick(_GUARDS)} AS guard FROM part")
def _(t):
    g = t("part").select("p_partkey", code_text.guard(pick(_CONDITIONS)).alias("g"))
    told = F.concat_ws(" ", "g.operand", "g.operator", F.coalesce("g.value", F.lit("")), "g.guard_kind")
    return g.select("p_partkey", F.when(F.col("g").isNull(), "none").otherwise(told).alias("guard"))


@query("f_business_condition", f"SELECT p_partkey, {sql_pick(_BUSINESS)} AS told FROM part")
def _(t):
    b = t("part").select("p_partkey", code_text.business_condition(pick(_CONDITIONS)).alias("b"))
    return b.select("p_partkey", F.concat_ws(" ", F.col("b.confidence").cast("string"), "b.variable", "b.operator", F.coalesce("b.threshold", F.lit(""))).alias("told"))


_ANNOTATIONS = ("@NotNull @Size(min = 1, max = 5) String name;", "@Email @NotBlank String mail;", "@Valid Address a;", "@PositiveOrZero int n;", "@Min(1) @Max(9) @Pattern(regexp = \"x\") String y;", "@Size String z;", "int plain;")
_RULES = ("required,length", "required,format", "nested", "range,range", "range,range,format", "", "")


@query("f_validations", f"SELECT p_partkey, {sql_pick(_RULES)} AS rules FROM part")
def _(t):
    return t("part").select("p_partkey", F.array_join(F.transform(code_text.validations(pick(_ANNOTATIONS)), lambda v: v["rule"]), ",").alias("rules"))


_MARKDOWN = ("before\n# 1. Scope\nfirst line\n\n## Goals\nwin\n", "## 2 Scope\na\n# Scope\nlast counts", "#### too deep\nno section", "no heading at all", "### Only\n")
_SECTIONS = ("Goals=win;Scope=first line", "Scope=last counts", "", "", "Only=")


@query("f_markdown_sections", f"SELECT p_partkey, {sql_pick(_SECTIONS)} AS sections FROM part")
def _(t):
    entries = F.array_sort(F.transform(F.map_entries(code_text.markdown_sections(pick(_MARKDOWN))), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return t("part").select("p_partkey", F.array_join(entries, ";").alias("sections"))


_URLS = ("orders.html?mode=edit&amp;x=1", "points?pageSelect=pointInfoMaintenance", "points?pageSelect=pointWizard&mode=view", "a/b.html?mode=other", "plain", "points?mode=TRUE")
_TARGETS = ("orders||edit|url-param", "points|pointInfoMaintenance|maintenance|pageSelect-suffix", "points|pointWizard|inquiry|url-param", "|||", "plain|||", "points||maintenance|url-param")


@query("f_menu_target", f"SELECT p_partkey, {sql_pick(_TARGETS)} AS target FROM part")
def _(t):
    m = t("part").select("p_partkey", parsers.menu_target(pick(_URLS)).alias("m"))
    return m.select("p_partkey", F.concat_ws("|", *(F.coalesce(f"m.{c}", F.lit("")) for c in ("flow", "view", "mode", "source"))).alias("target"))


# Detectors

_CLASSES = ('@RestController @RequestMapping("/api/")', "class Plain {}", '@Controller("users")')
_BASES = ("/api", "", "users")
_METHODS = (
    '@GetMapping("/orders/{id}") Order one() {}', '@PostMapping("orders") void add() {}', '@RequestMapping(value = "/x", method = RequestMethod.PUT) void x() {}', "@Get('list') list() {}", '@app.get("/items/{item}")\ndef one(): pass',
    '@app.route("/h", methods=["POST"])\ndef h(): pass', 'router.post("/u/:user", h)', 'r.GET("/ping", f)', '[HttpGet("{id}")] public X Get() {}', "path('blog/<slug>', v)", "@Query() async orders() {}", "@Query(returns) orders() {}",
    "@QueryMapping public Book book() {}", '@KafkaListener(topics = "orders") void take(String s) {}', 'bus.on("paid", h)', "@shared_task()\ndef run(): pass", '@Scheduled(cron = "0 0 * * *") void tick() {}',
    "@Scheduled(fixedRate = 500) void tick() {}", "@Interval(1000) tick() {}", "@click.command() def run(): pass", 'program.command("build")', "int plain(int x) { return x; }", '@app.task() @scheduler.scheduled_job("cron", hour=3) def run(): pass',
)
_FOUND = (
    (0, "rest", "Spring", "GET", "/orders/{id}", "id", "EXPOSES_ENDPOINT"), (1, "rest", "Spring", "POST", "orders", "", "EXPOSES_ENDPOINT"), (2, "rest", "Spring", "PUT", "/x", "", "EXPOSES_ENDPOINT"),
    (3, "rest", "NestJS", "GET", "list", "", "EXPOSES_ENDPOINT"), (4, "rest", "FastAPI", "GET", "/items/{item}", "item", "EXPOSES_ENDPOINT"), (5, "rest", "Flask", "POST", "/h", "", "EXPOSES_ENDPOINT"),
    (6, "rest", "Express", "POST", "/u/:user", "user", "EXPOSES_ENDPOINT"), (7, "rest", "Gin", "GET", "/ping", "", "EXPOSES_ENDPOINT"), (8, "rest", "ASP.NET", "GET", "{id}", "id", "EXPOSES_ENDPOINT"),
    (9, "rest", "Django", "GET", "blog/<slug>", "slug", "EXPOSES_ENDPOINT"), (10, "graphql", "Apollo", "Query", "orders", "", "RESOLVES_OPERATION"), (11, "graphql", "NestJS", "Query", "orders", "", "RESOLVES_OPERATION"),
    (12, "graphql", "Spring", "Query", "book", "", "RESOLVES_OPERATION"), (13, "event", "Spring", "Kafka", "orders", "", "HANDLES_EVENT"), (14, "event", "Node.js", "EventEmitter", "paid", "", "HANDLES_EVENT"),
    (15, "event", "Celery", "Celery", "run", "", "HANDLES_EVENT"), (16, "scheduled", "Spring", "cron", "0 0 * * *", "", "SCHEDULED_BY"), (17, "scheduled", "Spring", "fixedRate", "500", "", "SCHEDULED_BY"),
    (18, "scheduled", "NestJS", "interval", "1000", "", "SCHEDULED_BY"), (19, "cli", "Click", "", "run", "", "INVOKED_BY_CLI"), (20, "cli", "Commander", "", "build", "", "INVOKED_BY_CLI"),
    (22, "event", "Celery", "Celery", "run", "", "HANDLES_EVENT"), (22, "scheduled", "APScheduler", "cron", None, "", "SCHEDULED_BY"),
)
_FOUND_SQL = "f(m, family, framework, detail, value, parameters, edge) AS (VALUES " + ", ".join(
    "(" + ", ".join("NULL" if x is None else str(x) if isinstance(x, int) else f"'{x}'" for x in r) + ")" for r in _FOUND) + ")"


def _entry_nodes(t):
    part = t("part")
    holder = F.concat(F.lit("c:"), F.col("p_partkey").cast("string"))
    of = lambda id_, parent, kind, name, text: part.select(id_.alias("id"), parent.alias("parent_id"), F.lit(kind).alias("kind"), F.lit(name).alias("name"), text.alias("text"))
    return of(holder, F.lit(None).cast("string"), "JavaClass", "Holder", pick(_CLASSES)).unionByName(of(F.concat(F.lit("m:"), F.col("p_partkey").cast("string")), holder, "Method", "run", pick(_METHODS)))


@query("d_entry_points", f"""WITH {_FOUND_SQL}, b AS (SELECT p_partkey, p_partkey % {len(_METHODS)} AS m, {sql_pick(_BASES)} AS base FROM part)
SELECT 'm:' || b.p_partkey AS id, f.family, f.framework, f.detail, f.value, CASE WHEN f.family = 'rest' THEN b.base || CASE WHEN starts_with(f.value, '/') THEN f.value ELSE '/' || f.value END END AS path, f.parameters, f.edge FROM b JOIN f ON b.m = f.m""")
def _(t):
    found = detect.entry_points(_entry_nodes(t))
    return found.select("id", "family", "framework", "detail", "value", "path", F.coalesce(F.array_join("parameters", ","), F.lit("")).alias("parameters"), "edge")


@query("a8_entry_point_rollup", f"WITH {_FOUND_SQL}, b AS (SELECT p_partkey % {len(_METHODS)} AS m FROM part) SELECT f.family, count(*) AS n, count(DISTINCT f.framework) AS frameworks FROM b JOIN f ON b.m = f.m GROUP BY f.family")
def _(t):
    return detect.entry_points(_entry_nodes(t)).groupBy("family").agg(F.count("*").alias("n"), F.count_distinct("framework").alias("frameworks"))


_MANIFESTS = (
    ("package.json", '{"dependencies":{"express":"^4","react":"18"},"devDependencies":{"jest":"29"}}'), ("pom.xml", "<artifactId>spring-boot-starter-web</artifactId><artifactId>junit-jupiter</artifactId>"),
    ("requirements.txt", "Django==4.2\ncelery>=5\n"), ("go.mod", "module x\nrequire github.com/gin-gonic/gin v1.9"), ("app.csproj", '<PackageReference Include="Dapper" Version="2"/>'), ("pyproject.toml", 'dependencies = ["flask"]'),
    ("build.gradle", 'implementation "io.quarkus:quarkus-core"'), ("README.md", "express"),
)
_SOURCES = ('import React from "react"; useState(0)', "@RestController class A {}", 'from fastapi import FastAPI\n@app.get("/")', "plain text", "<template><script setup>createApp(x)")
_FRAMEWORKS = (
    ("Express", "backend", 0.95, "code: 1;package.json: express"), ("React", "frontend", 0.95, "code: 3;package.json: react"), ("Jest", "testing", 0.95, "package.json: jest"),
    ("Spring Boot", "backend", 0.95, "code: 1;pom.xml: spring-boot-starter, spring-boot-starter-web"), ("JUnit5", "testing", 0.95, "pom.xml: junit-jupiter"), ("JUnit", "testing", 0.95, "pom.xml: junit"),
    ("Django", "backend", 0.95, "requirements.txt: django"), ("Django ORM", "database", 0.8, "requirements.txt: django"), ("Celery", "messaging", 0.95, "requirements.txt: celery"), ("Go testing", "testing", 0.8, "go.mod: module"),
    ("Gin", "backend", 0.95, "go.mod: github.com/gin-gonic/gin"), ("Dapper", "database", 0.95, ".csproj: Dapper"), ("Flask", "backend", 0.855, "pyproject.toml: flask"), ("Quarkus", "backend", 0.95, "build.gradle: io.quarkus"),
    ("FastAPI", "backend", 0.95, "code: 2"), ("Vue", "frontend", 0.95, "code: 3"),
)


@query("d_frameworks", "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', CAST({c} AS DOUBLE), '{d}')" for a, b, c, d in _FRAMEWORKS) + ") v(framework, category, confidence, evidence)")
def _(t):
    part = t("part")
    manifests = part.select(F.concat(F.lit("m/"), F.col("p_partkey").cast("string"), F.lit("/"), pick([m for m, _ in _MANIFESTS])).alias("path"), pick([x for _, x in _MANIFESTS]).alias("text"))
    found = detect.frameworks(manifests, part.select(pick(_SOURCES).alias("text")))
    return found.select("framework", "category", "confidence", F.array_join("evidence", ";").alias("evidence"))


_TEST_FILES = (
    ("src/a.test.ts", "describe('cart', () => {\n it('adds', f)\n xit('later', f)\n fit('now', f)\n})\nbeforeEach(x)\njest.fn()", "Jest|9|1|src/a.ts|false|false|false|true|false|Jest", 9, 6),
    ("app/tests/test_user.py", "class TestUser:\n    def test_name(self): pass\n    @pytest.mark.skip\n    def test_age(self): pass\n    def setUp(self): pass", "pytest|2|1|app/src/user.py|false|false|false|true|false|", 2, 1),
    ("src/test/java/AIT.java", 'import org.junit.Test;\n@Test public void works() {}\n@Disabled @Test void off() {}\n@DisplayName("x")\n@AfterEach void end() {}\nMockito.mock(A.class)', "JUnit5|3|0|src/main/java/A.java|true|false|false|false|true|Mockito", 3, 1),
    ("calc/add_test.go", 'func TestAdd(t *testing.T) {\n t.Skip("x")\n}\nfunc BenchmarkAdd(b *testing.B) {}', "Go testing|2|0|calc/add.go|false|false|false|false|false|", 2, 0), ("src/plain.ts", "export const x = 1", "", 0, 0),
    ("lib/check.js", "import { test } from 'vitest'\ntest('x', f)", "Vitest|3|0||false|false|false|false|false|", 3, 0), ("e2e/login.spec.ts", "test('login', f)\nafterAll(x)", "Jest|3|0|e2e/login.ts|false|false|true|false|true|", 3, 0),
)


def _test_sources(t):
    path = F.concat(F.col("p_partkey").cast("string"), F.lit("/"), pick([x[0] for x in _TEST_FILES]))
    return t("part").select("p_partkey", path.alias("path"), pick([x[1] for x in _TEST_FILES]).alias("text"))


@query("d_tests", f"WITH x AS (SELECT p_partkey, {sql_pick([x[2] for x in _TEST_FILES])} AS told FROM part) SELECT p_partkey, told FROM x WHERE told <> ''")
def _(t):
    rows = detect.test_files(_test_sources(t)).withColumn("p_partkey", F.regexp_extract("path", "^([0-9]+)/", 1).cast("long"))
    flags = [F.col(c).cast("string") for c in ("n_cases", "n_suites")] + [F.coalesce(F.regexp_replace("tested", "^[0-9]+/", ""), F.lit(""))] + [F.col(c).cast("string") for c in (*detect.TEST_TYPES, "setup", "teardown")]
    return rows.select("p_partkey", F.concat_ws("|", "framework", *flags, F.array_join("mocks", ",")).alias("told"))


@query("d_test_cases", f"WITH x AS (SELECT p_partkey, CAST({sql_pick([str(x[3]) for x in _TEST_FILES])} AS BIGINT) AS n, CAST({sql_pick([str(x[4]) for x in _TEST_FILES])} AS BIGINT) AS skipped FROM part) SELECT * FROM x WHERE n > 0")
def _(t):
    """Skipped counts cases whose line, or the line before, says so; a case that follows a skipped one is one too."""
    rows = detect.test_cases(_test_sources(t)).withColumn("p_partkey", F.regexp_extract("path", "^([0-9]+)/", 1).cast("long")).where("case is not null")
    return rows.groupBy("p_partkey").agg(F.count("*").alias("n"), F.count_if("skipped").alias("skipped"))


@query("a12_test_stats", f"""WITH x AS (SELECT string_split({sql_pick([x[2] for x in _TEST_FILES])}, '|') AS f, CAST({sql_pick([str(x[3]) for x in _TEST_FILES])} AS BIGINT) AS n FROM part)
SELECT f[1] AS framework, count(*) AS files, CAST(sum(n) AS BIGINT) AS cases, count(*) FILTER (f[8] = 'true') AS with_setup FROM x WHERE f[1] <> '' GROUP BY f[1]""")
def _(t):
    return detect.test_files(_test_sources(t)).groupBy("framework").agg(F.count("*").alias("files"), F.sum("n_cases").alias("cases"), F.count_if("setup").alias("with_setup"))


# Name, annotations, interfaces, methods, fields; then the stereotype and confidence by the rules (an annotation that holds another's name is one, too).
_CLASS_ROWS = (
    ("UserController", "@RestController", "", "", "", "Controller", "0.935"), ("OrderService", "@Service", "", "", "", "Service", "0.935"), ("UserRepository", "", "", "findByName", "", "Repository", "0.8525"),
    ("Customer", "", "", "", "id", "Entity", "0.5"), ("OrderDTO", "", "", "", "", "DTO", "0.9"), ("AppConfig", "", "", "", "", "Configuration", "0.8"), ("StringUtils", "", "", "", "", "Utility", "0.9"),
    ("WidgetFactory", "", "", "createWidget", "", "Factory", "0.8525"), ("QueryBuilder", "", "", "build", "", "Builder", "0.88"), ("Thing", "", "", "", "", "Unknown", "0"), ("AuthGuard", "@Injectable", "", "", "", "Entity", "0.95"),
    ("PaymentClient", "@FeignClient", "", "", "", "Client", "0.9625"), ("EmailListener", "@KafkaListener", "", "", "", "Handler", "0.9625"), ("RequestValidator", "", "Validator", "validate", "", "Validator", "0.8525"),
    ("OrderMapper", "@Mapper", "", "toDto", "", "Mapper", "1"),
)


def _classes(t):
    listed = lambda i: F.filter(F.split(pick([r[i] for r in _CLASS_ROWS]), ","), lambda x: x != "")
    s = classify.stereotype_of(pick([r[0] for r in _CLASS_ROWS]), listed(1), listed(2), listed(3), listed(4))
    part = t("part").select("p_partkey")
    part = part.repartition(int(part.sparkSession.conf.get("spark.sql.shuffle.partitions")), "p_partkey")  # the file is small for the work in it
    return part.select("p_partkey", s.alias("s")).select("p_partkey", "s.stereotype", F.round("s.confidence", 6).alias("confidence"))


@query("d_stereotypes", f"SELECT p_partkey, {sql_pick([r[5] for r in _CLASS_ROWS])} AS stereotype, CAST({sql_pick([r[6] for r in _CLASS_ROWS])} AS DOUBLE) AS confidence FROM part")
def _(t):
    return _classes(t)


@query("a11_stereotype_distribution", f"SELECT {sql_pick([r[5] for r in _CLASS_ROWS])} AS stereotype, count(*) AS n FROM part GROUP BY 1")
def _(t):
    return _classes(t).groupBy("stereotype").agg(F.count("*").alias("n"))


_STEREOTYPE_LAYER = ("Controller", "Service", "Repository", "Entity", "Utility", "Unknown")


@query("d_layers", f"""WITH x AS (SELECT {sql_pick(_STEREOTYPE_LAYER)} AS stereotype, count(*) AS n FROM part GROUP BY 1)
SELECT stereotype, n, CASE stereotype WHEN 'Controller' THEN 'presentation' WHEN 'Service' THEN 'business' WHEN 'Repository' THEN 'data' WHEN 'Entity' THEN 'domain' WHEN 'Utility' THEN 'infrastructure' END AS layer,
'Layered 0.85,MVC 0.75,Modular 0.7' AS patterns FROM x""")
def _(t):
    counts = t("part").select(pick(_STEREOTYPE_LAYER).alias("stereotype")).groupBy("stereotype").agg(F.count("*").alias("n"))
    found = counts.agg(reports.architecture(counts, 3).alias("p")).select(F.array_join(F.transform("p", lambda x: F.concat(x["pattern"], F.lit(" "), x["confidence"].cast("string"))), ",").alias("patterns"))
    return counts.select("stereotype", "n", ladders.stereotype_layer(F.col("stereotype")).alias("layer")).join(F.broadcast(found))


# Comment, description, kind, parameters, documented ones, result, whether it is documented; then score and level.
_DOCS = (
    ("1", "Adds one line to the order.", "f", "2", "2", "int", "1", "1.0", "excellent"), ("1", "Adds one line to the order.", "f", "2", "1", "void", "0", "0.75", "good"), ("1", "TODO", "c", "0", "0", "", "0", "0.333333", "minimal"),
    ("0", "", "c", "0", "0", "", "0", "0.0", "none"), ("1", "Gets the name", "f", "0", "0", "str", "0", "0.5", "partial"), ("1", "A class of orders.", "c", "0", "0", "", "0", "1.0", "excellent"),
)


@query("d_doc_quality", f"SELECT p_partkey, CAST({sql_pick([r[7] for r in _DOCS])} AS DOUBLE) AS score, {sql_pick([r[8] for r in _DOCS])} AS level FROM part")
def _(t):
    of = lambda i: pick([r[i] for r in _DOCS])
    s = classify.doc_score(of(0) == "1", F.nullif(of(1), F.lit("")), of(2) == "f", of(3).cast("int"), of(4).cast("int"), F.nullif(of(5), F.lit("")), of(6) == "1")
    return t("part").select("p_partkey", s.alias("s")).select("p_partkey", F.round("s.score", 6).alias("score"), "s.level")


# Flag, tags, comment, language, modifiers; then whether it is deprecated.
_OLD = (
    ("1", "", "", "java", "", "true"), ("0", "Deprecated", "", "java", "", "true"), ("0", "", "/** @deprecated use x */", "typescript", "", "true"), ("0", "", ".. deprecated:: 2", "python", "", "true"), ("0", "", "[Obsolete]", "csharp", "", "true"),
    ("0", "", "[obsolete]", "csharp", "", "false"), ("0", "", "", "java", "@Deprecated", "true"), ("0", "since", "plain", "go", "public", "false"), ("0", "", "Deprecated: no", "go", "", "true"),
)


@query("d_deprecation", f"SELECT p_partkey, {sql_pick([r[5] for r in _OLD])} AS deprecated FROM part")
def _(t):
    of = lambda i: pick([r[i] for r in _OLD])
    listed = lambda i: F.filter(F.split(of(i), ","), lambda x: x != "")
    return t("part").select("p_partkey", classify.is_deprecated(of(0) == "1", listed(1), of(2), of(3), listed(4)).cast("string").alias("deprecated"))


_JAVA = ("@NotNull private String name;\nif (order == null) { throw new X(); }\nif (amount > 100) {\n  apply();\n}\nassertEquals(1, x);", "/* if (a == null) { return; }\n @NotNull */\nint x;\n@Email String m;", "int plain;")
_FOUND_RULES = ("1 ValidationConstraint required;2 GuardClause null_check;3 ConditionalBusinessLogic amount;6 TestAssertion assertEquals", "4 ValidationConstraint format", "")


@query("d_business_rules", f"WITH x AS (SELECT p_partkey, {sql_pick(_FOUND_RULES)} AS rules FROM part) SELECT * FROM x WHERE rules <> ''")
def _(t):
    files = t("part").select(F.col("p_partkey").alias("path"), pick(_JAVA).alias("text"))
    line = F.concat_ws(" ", F.col("line").cast("string"), "kind", "rule")
    found = parsers.business_rules(files).groupBy(F.col("path").alias("p_partkey")).agg(F.array_sort(F.collect_list(line)).alias("r"))
    return found.select("p_partkey", F.array_join("r", ";").alias("rules"))
