"""Ordered classifications: the first rule that matches decides."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_match(value: Column, rules: Sequence[tuple[str, object]], default: object = None) -> Column:
    """The outcome of the first (pattern, outcome) whose pattern is found in ``value``."""
    out = None
    for pattern, outcome in rules:
        hit = value.rlike(pattern)
        result = outcome if isinstance(outcome, Column) else F.lit(outcome)
        out = F.when(hit, result) if out is None else out.when(hit, result)
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


# A feature's name and confidence by its base path, in order.
FEATURE_NAMES = (
    (r"(?i)/users?(/|$)", "User Management", 0.9), (r"(?i)/profile(/|$)", "User Profile", 0.9), (r"(?i)/account(/|$)", "Account Management", 0.9),
    (r"(?i)/settings(/|$)", "Settings", 0.85), (r"(?i)/login(/|$)", "Authentication", 0.95), (r"(?i)/signup|/register(/|$)", "User Registration", 0.95),
    (r"(?i)/forgot-password|/reset-password(/|$)", "Password Recovery", 0.95), (r"(?i)/auth(/|$)", "Authentication", 0.9), (r"(?i)/products?(/|$)", "Product Catalog", 0.9),
    (r"(?i)/cart(/|$)", "Shopping Cart", 0.95), (r"(?i)/checkout(/|$)", "Checkout", 0.95), (r"(?i)/orders?(/|$)", "Order Management", 0.9), (r"(?i)/payments?(/|$)", "Payment Processing", 0.9),
    (r"(?i)/blog|/posts?(/|$)", "Blog", 0.85), (r"(?i)/articles?(/|$)", "Articles", 0.85), (r"(?i)/news(/|$)", "News", 0.85), (r"(?i)/pages?(/|$)", "Content Pages", 0.7),
    (r"(?i)/admin(/|$)", "Admin Dashboard", 0.9), (r"(?i)/dashboard(/|$)", "Dashboard", 0.85), (r"(?i)/analytics(/|$)", "Analytics", 0.9), (r"(?i)/reports?(/|$)", "Reporting", 0.85),
    (r"(?i)/messages?|/inbox(/|$)", "Messaging", 0.9), (r"(?i)/notifications?(/|$)", "Notifications", 0.9), (r"(?i)/chat(/|$)", "Chat", 0.9), (r"(?i)/search(/|$)", "Search", 0.9),
)
_DETAIL, _LIST = r"(?i)/(\w+)/[:*\[\]]\w+$", r"(?i)/(\w+)s$"


def _title(text: Column) -> Column:
    return F.initcap(F.regexp_replace(text, "-", " "))


def component_title(name: Column) -> Column:
    """A component's name in words, without Page, Component or View at its end."""
    spaced = F.regexp_replace(F.regexp_replace(name, "([a-z])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.trim(F.regexp_replace(spaced, "(?i)(Page|Component|View)$", ""))


# Words that stay in capitals.
ACRONYMS = ("edi", "duns", "api", "ui", "csr", "xml")


def camel_title(name: Column) -> Column:
    """A camelCase name as words with a capital each; known acronyms are all capitals."""
    spaced = F.regexp_replace(F.regexp_replace(name, "([a-z])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    words = F.filter(F.split(F.lower(spaced), r"\s+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.when(w.isin(*ACRONYMS), F.upper(w)).otherwise(F.initcap(w))), " ")


def feature_name(base: Column, component: Column | None = None) -> Column:
    """struct(name, confidence) of a feature: by its path, else its component (0.7), else its last
    segment (0.5)."""
    as_struct = lambda n, c: F.struct((n if isinstance(n, Column) else F.lit(n)).alias("name"), F.lit(c).alias("confidence"))
    last = F.element_at(F.concat(F.array(F.lit("Home")), F.filter(F.split(base, "/"), lambda x: x != "")), -1)
    fallback = as_struct(_title(last), 0.5)
    if component is not None:
        fallback = F.when(component.isNotNull(), as_struct(component_title(component), 0.7)).otherwise(fallback)
    rules = [(p, as_struct(n, c)) for p, n, c in FEATURE_NAMES]
    rules += [(_DETAIL, as_struct(F.concat(_title(F.regexp_extract(base, _DETAIL, 1)), F.lit(" Details")), 0.75))]
    rules += [(_LIST, as_struct(F.concat(_title(F.regexp_extract(base, _LIST, 1)), F.lit(" Management")), 0.6))]
    return first_match(base, rules, fallback)


def feature_category(base: Column) -> Column:
    return first_match(base, ((r"(?i)/admin|/dashboard|/manage", "admin"), (r"(?i)/api/", "api-only"), (r"(?i)/internal|/system", "internal")), "user-facing")


def size_class(n: Column) -> Column:
    """simple up to 3 parts, moderate up to 8, else complex."""
    return F.when(n <= 3, "simple").when(n <= 8, "moderate").otherwise("complex")


def footprint(parts: Sequence[tuple[Column, float, float]]) -> Column:
    """struct(score, level): the sum of min(n * weight, cap); levels change at 25, 50 and 75."""
    score = sum((F.least(n * F.lit(w), F.lit(cap)) for n, w, cap in parts), F.lit(0.0))
    return F.struct(score.alias("score"), F.when(score < 25, "LOW").when(score < 50, "MEDIUM").when(score < 75, "HIGH").otherwise("VERY_HIGH").alias("level"))


# The rules of each variant of layers, in order: layer, pattern of the kind, pattern of the name (either decides; "" never does).
LAYERS = {
    "flow": (
        ("UI", "jsp", ""), ("Flow", "webflow|flowstate", ""), ("Controller", "", "(action|controller)$"), ("DAO", "", "dao|repository"),
        ("Service", "", "service|builder|validator"), ("Entity", "^javaclass$", ""),
    ),
    "chain": (
        ("UI", "^jsppage$", ""), ("Flow", "^(webflowdefinition|flowstate)$", ""), ("Controller", "", "(action|controller)$"), ("DAO", "", "dao|repository"), ("Service", "", "service|builder"),
    ),
    "context": (
        ("ui", "jsp", ""), ("flow", "webflow|flowdefinition", ""), ("controller", "", "action|controller"), ("data", "", "dao|repository"), ("service", "", "service|validator|builder"),
    ),
    "implementation": (
        ("ui", "^(jsppage|jsp)$", ""), ("flow", "^webflowdefinition$", ""), ("controller", "", "(action|controller)$"), ("data", "", "dao|repository"), ("service", "", "service|builder|validator"),
    ),
    "explore": (
        ("presentation", "jsp|html|view", ""), ("presentation", "webflow|flowdefinition|flowstate", ""), ("controller", "controller|action", "action"), ("service", "service", "service"),
        ("service", "", "validator|builder"), ("data", "dao|repository|mapper|sqltable|sqlview", "dao|repository"), ("data", "", "/persistence/"),
    ),
}
OTHER_LAYER = {"flow": "Unknown", "chain": "Unknown", "context": "service", "implementation": "entity", "explore": "service"}


def layer(kind: Column, name: Column, variant: str = "flow", parent: Column | None = None) -> Column:
    """The architectural layer by the first rule of a variant that the kind or the name meets.

    A class that is named an action, but not at the end, is no entity of the flow variant; the chain
    variant takes the parent's name, if there is one, for data access and services.
    """
    kind, name = F.lower(kind), F.lower(name)
    owner = name if parent is None else F.coalesce(F.lower(parent), name)
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for what, by_kind, by_name in LAYERS[variant]:
        hit = kind.rlike(by_kind) if by_kind else F.lit(False)
        if by_name:
            hit = hit | (owner if variant == "chain" and what in ("DAO", "Service") else name).rlike(by_name)
        if (variant, what) == ("flow", "Entity"):
            hit = hit & ~name.rlike("action|service")
        out = out.when(F.coalesce(hit, F.lit(False)), what)
    return out.otherwise(OTHER_LAYER[variant])


# A stereotype's layer.
STEREOTYPE_LAYERS = {
    "Controller": "presentation", "Service": "business", "Repository": "data", "Entity": "domain", "DTO": "presentation", "Configuration": "infrastructure", "Utility": "infrastructure",
    "Factory": "business", "Builder": "business", "Middleware": "presentation", "Guard": "presentation", "Filter": "presentation", "Validator": "business", "Mapper": "business",
    "Client": "infrastructure", "Handler": "business", "Provider": "infrastructure", "Module": "infrastructure",
}


def stereotype_layer(stereotype: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in STEREOTYPE_LAYERS.items() for x in kv)), stereotype)


def file_category(path: Column) -> Column:
    """jsp, webflow, frontend, test, config or backend, by the path in lower case."""
    return first_match(F.lower(path), (
        (r"\.jsp$", "jsp"), (r"webflow|flow.*\.xml$", "webflow"), (r"\.(tsx|jsx|vue|html|css|scss)", "frontend"), (r"/(frontend|ui|web)/.*\.(ts|js)$", "frontend"),
        (r"test|spec", "test"), (r"config|application\.|settings|properties", "config"), (r"^(?!.*src/main).*\.(yaml|yml|properties|xml|json)$", "config"),
    ), "backend")


# Component categories in order, each by a pattern of the kind, the name or the path; "" never decides.
COMPONENTS = (
    ("service", "^javafield$", "service|repository|dao|validator|builder", "both"), ("other", "^javafield$", "", "kind"), ("other", "^javamethod$", "", "kind"),
    ("jsp", "^(jsppage|jspform|jspinclude|jsptaglib)$", "", "kind"), ("jsp", "", r"\.jsp$", "path"), ("webflow", "flow", "", "kind"), ("database", "^(sqltable|sqlview|sqlcolumn)$", "", "kind"),
    ("controller", "controller", "controller", "either"), ("controller", "^(class|javaclass|springservice)$", "action$", "both"), ("controller", "", "/actions/|/controller/", "path"),
    ("repository", "repository|dao", "repository|dao|mapper", "either"), ("repository", "", "/persistence/|/dao/|/repository/", "path"),
    ("service", "^springservice$", "^(?!.*action$)", "both"), ("service", "service", "", "kind"), ("service", "", "^(?!.*action$).*service", "name"),
    ("data_model", "entity|model|dto", "", "kind"), ("data_model", "", "/model/|/dto/|/entity/", "path"), ("service", "", "validator|builder", "name"),
    ("api", "endpoint|api|rest", "", "kind"), ("test", "", "test|spec", "name"),
)


def component_category(kind: Column, name: Column, path: Column) -> Column:
    """The category of a component by the first rule that its kind, name or path meets."""
    kind, name, path = (F.coalesce(F.lower(c), F.lit("")) for c in (kind, name, path))
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for what, first, second, where in COMPONENTS:
        by_kind, by_name = kind.rlike(first), name.rlike(second)
        hit = {"kind": by_kind, "name": by_name, "path": path.rlike(second), "both": by_kind & by_name, "either": by_kind | by_name}[where]
        out = out.when(hit, what)
    return out.otherwise("other")


def grade(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 75, "B").when(score >= 60, "C").when(score >= 40, "D").otherwise("F")


def severity(value: Column, threshold: Column, multipliers: tuple[float, float, float]) -> Column:
    """critical, high or medium from the third, second and first multiple of the threshold on, else low."""
    ratio = value / threshold
    a, b, c = multipliers
    return F.when(ratio >= c, "critical").when(ratio >= b, "high").when(ratio >= a, "medium").otherwise("low")


def confidence_level(confidence: Column) -> Column:
    return F.when(confidence >= 0.8, "high").when(confidence >= 0.5, "medium").when(confidence >= 0.3, "low").otherwise("insufficient")


def doc_level(score: Column) -> Column:
    return F.when(score >= 0.8, "excellent").when(score >= 0.6, "good").when(score >= 0.4, "partial").when(score > 0, "minimal").otherwise("none")


def operation_type(method: Column) -> Column:
    """read, write, validate or transform by the verb that a method's name contains, else null."""
    return first_match(F.lower(method), (
        ("get|find|search|load|read", "read"), ("save|create|insert|add|persist", "write"), ("update|modify|edit", "write"), ("delete|remove", "write"),
        ("validate|check|verify", "validate"), ("build|convert|transform|map", "transform"),
    ))


def triggers(action: Column) -> Column:
    """What sets off a rule, from the name of its action; several may hold, and save and update do where none does."""
    name = F.lower(F.coalesce(action, F.lit("")))
    rules = (("save|create|add", "save"), ("save|create|add", "create"), ("update|edit|modify", "update"), ("delete|remove", "delete"), ("validate|check", "validate"))
    found = F.array_compact(F.array(*(F.when(name.rlike(p), F.lit(t)) for p, t in rules)))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("save"), F.lit("update")))


# Types of screens in the order in which they are tried.
SCREENS = ("wizard", "search", "lookup", "inquiry", "results", "maintenance", "entry")


def screen_type(name: Column, pages: Column | None = None) -> Column:
    """The first type that the screen's id or one of its pages' names contains, else unknown."""
    text = F.lower(name) if pages is None else F.concat_ws(" ", F.lower(name), F.lower(F.array_join(pages, " ")))
    return first_match(text, [(x, x) for x in SCREENS], "unknown")


def humanised(name: Column) -> Column:
    """A space before every capital, and a capital at the start."""
    spaced = F.regexp_replace(name, "([A-Z])", " $1")
    return F.trim(F.concat(F.upper(F.left(spaced, F.lit(1))), F.substring(spaced, 2, 1 << 20)))


# Business categories by the words that they contain, in order.
BUSINESS_CATEGORIES = (
    ("auth|login|logout|session|oauth|sso|credential", "authentication"), ("user|profile|account|member|customer|register", "user_management"),
    ("payment|billing|invoice|subscription|checkout|cart", "payment"), ("admin|manage|dashboard|console", "admin"), ("report|analytics|stats|metrics|export", "reporting"),
    ("search|filter|find|query|lookup", "search"), ("notify|alert|email|sms|push|message", "notification"), ("config|setting|preference|option", "configuration"),
    ("workflow|process|flow|step|wizard", "workflow"), ("integrat|api|external|webhook|sync", "integration"), ("create|update|delete|edit|save|load|data", "data_management"),
)


def business_category(*texts: Column) -> Column:
    """The first category with a word in the feature's name, controller or paths together."""
    return first_match(F.lower(F.concat_ws(" ", *texts)), BUSINESS_CATEGORIES, "other")
