"""Rule tables against nodes: stereotypes, documentation, deprecation, shared components."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelattice.functions.ladders import doc_level


@dataclass(frozen=True)
class Stereotype:
    """What marks a stereotype: annotations, endings of the name, and structure, with a confidence each."""

    name: str
    annotations: tuple[str, ...]
    annotation_confidence: float
    suffixes: tuple[str, ...]
    suffix_confidence: float
    methods: tuple[str, ...] = ()
    interfaces: tuple[str, ...] = ()
    fields: tuple[str, ...] = ()
    structure_confidence: float = 0.0
    patterns: tuple[str, ...] = field(default=())


# The stereotypes in the order in which ties are decided.
STEREOTYPES = (
    Stereotype(
        "Controller", ("@Controller", "@RestController", "@RequestMapping", "@Get", "@Post", "@Put", "@Delete", "@Patch", "@ApiController", "@Route", "@HttpGet", "@HttpPost", "@app.route", "@router.route", "@api.route"), 0.95,
        ("Controller", "Resource", "Endpoint", "Api", "Handler"), 0.75,
        methods=("get", "post", "put", "delete", "patch", "handle"), interfaces=("Controller", "IController"), structure_confidence=0.6,
    ),
    Stereotype(
        "Service", ("@Service", "@Injectable", "@Component", "@Transactional", "@ApplicationScoped"), 0.9,
        ("Service", "ServiceImpl", "Manager", "Coordinator", "Orchestrator"), 0.8,
        interfaces=("Service", "IService"), structure_confidence=0.6,
    ),
    Stereotype(
        "Repository", ("@Repository", "@Dao", "@Mapper", "@PersistenceContext", "@DataJpaTest"), 0.95,
        ("Repository", "Repo", "Dao", "DataAccess", "Store", "Persistence"), 0.85,
        methods=("find", "findAll", "findById", "save", "delete", "update", "get", "create"), interfaces=("Repository", "CrudRepository", "JpaRepository", "IRepository"), structure_confidence=0.7,
    ),
    Stereotype(
        "Entity", ("@Entity", "@Table", "@Document", "@Model", "@Id", "@Column", "@ManyToOne", "@OneToMany", "@dataclass", "@attr.s"), 0.95,
        ("Entity", "Model", "Domain", "Aggregate"), 0.6,
        fields=("id", "createdAt", "updatedAt"), structure_confidence=0.5,
    ),
    Stereotype(
        "DTO", ("@Data", "@Value", "@Builder", "@JsonProperty", "@Serializable"), 0.7,
        ("DTO", "Dto", "Request", "Response", "Payload", "Input", "Output", "View", "VM"), 0.9,
        patterns=(r"^Get\w+Response$", r"^Create\w+Request$", r"^\w+DTO$"),
    ),
    Stereotype(
        "Configuration", ("@Configuration", "@ConfigurationProperties", "@Bean", "@Module", "@Settings", "@Config", "@EnableAutoConfiguration", "@ComponentScan"), 0.95,
        ("Config", "Configuration", "Settings", "Properties", "Options"), 0.8,
    ),
    Stereotype(
        "Utility", ("@UtilityClass", "@NoArgsConstructor(access = AccessLevel.PRIVATE)"), 0.9,
        ("Utils", "Util", "Helper", "Helpers", "Utilities", "Tools"), 0.9,
    ),
    Stereotype(
        "Factory", ("@Factory",), 0.9,
        ("Factory", "Creator", "Builder", "Maker"), 0.85,
        methods=("create", "build", "make", "getInstance", "newInstance"), structure_confidence=0.7, patterns=(r"^Create\w+$", r"^\w+Factory$"),
    ),
    Stereotype(
        "Builder", ("@Builder",), 0.95,
        ("Builder",), 0.9,
        methods=("build", "with", "set"), structure_confidence=0.7,
    ),
    Stereotype(
        "Middleware", ("@Middleware", "@UseInterceptors", "@UseGuards", "@UseFilters", "@Intercept"), 0.9,
        ("Middleware", "Interceptor", "Filter"), 0.85,
        methods=("intercept", "use", "handle", "invoke"), interfaces=("Middleware", "NestMiddleware", "Interceptor"), structure_confidence=0.7,
    ),
    Stereotype(
        "Guard", ("@Guard", "@CanActivate", "@Authorize"), 0.9,
        ("Guard", "AuthGuard", "RoleGuard"), 0.85,
        methods=("canActivate", "authorize", "validate"), interfaces=("CanActivate", "Guard", "IAuthorizationHandler"), structure_confidence=0.7,
    ),
    Stereotype(
        "Filter", ("@ExceptionHandler", "@Catch", "@Filter"), 0.9,
        ("Filter", "ExceptionFilter", "ExceptionHandler"), 0.8,
        methods=("catch", "filter", "doFilter", "handleException"), interfaces=("ExceptionFilter", "Filter", "IExceptionHandler"), structure_confidence=0.7,
    ),
    Stereotype(
        "Validator", ("@Validator", "@Valid", "@Validated"), 0.85,
        ("Validator", "Validation", "Constraint"), 0.85,
        methods=("validate", "isValid", "check"), interfaces=("Validator", "ConstraintValidator", "IValidator"), structure_confidence=0.7,
    ),
    Stereotype(
        "Mapper", ("@Mapper", "@Mapping"), 0.95,
        ("Mapper", "Converter", "Transformer", "Assembler"), 0.85,
        methods=("map", "convert", "transform", "toEntity", "toDto", "from"), interfaces=("Mapper", "Converter", "IMapper"), structure_confidence=0.7,
    ),
    Stereotype(
        "Client", ("@FeignClient", "@WebClient", "@HttpClient"), 0.95,
        ("Client", "Api", "Gateway", "Proxy", "Adapter"), 0.8,
        patterns=(r"^\w+Client$", r"^\w+Api$"),
    ),
    Stereotype(
        "Handler", ("@EventHandler", "@MessageHandler", "@CommandHandler", "@EventListener", "@KafkaListener", "@RabbitListener"), 0.95,
        ("Handler", "Listener", "Consumer", "Subscriber"), 0.8,
        methods=("handle", "on", "process", "consume"), structure_confidence=0.6,
    ),
    Stereotype(
        "Provider", ("@Provider", "@Provides", "@Bean"), 0.85,
        ("Provider", "Supplier"), 0.8,
        methods=("provide", "get", "supply"), structure_confidence=0.6,
    ),
    Stereotype(
        "Module", ("@Module", "@NgModule"), 0.95,
        ("Module",), 0.7,
    ),
)


def _has(values: Column, wanted: Sequence[str], exact: bool = False) -> Column:
    """Whether any of the lower-case values contains (or is) one of the words; an annotation is looked for without its ``@``."""
    words = [w.lower().replace("@", "") for w in wanted]
    test = (lambda v, w: v == w) if exact else (lambda v, w: F.contains(v, F.lit(w)))
    return F.exists(values, lambda v: reduce(or_, (test(v, w) for w in words))) if words else F.lit(False)


def stereotype_of(
    name: Column, annotations: Column, interfaces: Column, methods: Column, fields: Column, *, least: float = 0.5, table: Sequence[Stereotype] = STEREOTYPES,
) -> Column:
    """struct(stereotype, confidence): the best stereotype with at least ``least``, else Unknown.

    The confidences of the kinds of evidence that match are averaged and raised by a tenth for each
    kind beyond the first, to 1 at most; the first of equals wins. Words and patterns of the rule table are literals, so that no pattern
    is compiled for a row; values are lower-cased and the best stereotype is found once a row.
    """
    none = F.array().cast("array<string>")
    low = F.struct(name.alias("name"), *(F.transform(F.coalesce(c, none), F.lower).alias(n) for c, n in ((annotations, "annotations"), (interfaces, "interfaces"), (methods, "methods"), (fields, "fields"))))

    def evidence(s: Stereotype, x: Column) -> Column:
        names = "|".join([f"({p})$" for p in s.suffixes] + [f"({p})" for p in s.patterns])
        shape = _has(x["interfaces"], s.interfaces) | _has(x["methods"], s.methods) | _has(x["fields"], s.fields, exact=True)
        return F.array_compact(F.array(
            F.when(_has(x["annotations"], s.annotations), s.annotation_confidence), F.when(x["name"].rlike(names), s.suffix_confidence), F.when(shape, s.structure_confidence)))

    mean = lambda x: F.aggregate(x, F.lit(0.0), lambda a, b: a + b) / F.size(x) * (1 + (F.size(x) - 1) * 0.1)
    scored = F.transform(F.array(low), lambda x: F.array(*(
        F.struct(evidence(s, x).alias("found"), F.lit(-n).alias("order"), F.lit(s.name).alias("stereotype")) for n, s in enumerate(table))))[0]
    ranked = F.transform(scored, lambda r: F.struct(
        F.when(F.size(r["found"]) > 0, F.least(F.lit(1.0), mean(r["found"]))).otherwise(0.0).alias("confidence"), r["order"].alias("order"), r["stereotype"].alias("stereotype")))
    return F.transform(F.array(F.array_max(ranked)), lambda best: F.struct(
        F.when(best["confidence"] >= least, best["stereotype"]).otherwise("Unknown").alias("stereotype"),
        F.when(best["confidence"] >= least, best["confidence"]).otherwise(0.0).alias("confidence"),
    ))[0]


# Descriptions that a tool wrote.
AUTOMATIC = (r"^TODO:?\s*$", r"^FIXME:?\s*$", r"^Gets?\s+the\s+\w+\.?$", r"^Sets?\s+the\s+\w+\.?$", r"^The\s+\w+\.?$", r"^Returns?\s+the\s+\w+\.?$", r"^Constructor\.?$", r"^Default\s+constructor\.?$",
             r"^Creates?\s+a\s+new\s+instance\.?$", r"^Auto-generated", r"^Generated\s+by")


def doc_score(has_doc: Column, description: Column, is_function: Column, params: Column, documented: Column, returns: Column, documents_return: Column, shortest: int = 10) -> Column:
    """struct(score, level, documented): hits over three checks, four or five for functions with
    parameters or a result."""
    empty = F.coalesce(F.length(description), F.lit(0)) == 0
    auto = F.coalesce(F.trim(description).rlike("(?i)" + "|".join(AUTOMATIC)), F.lit(False))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    hits = flag(has_doc) + flag(F.length(description) >= shortest) + flag(~empty & ~auto)
    with_params, with_result = F.coalesce(is_function & (params > 0), F.lit(False)), F.coalesce(is_function & ~returns.isin("void", "None"), F.lit(False))
    hits = hits + F.when(with_params, flag(F.try_divide(documented.cast("double"), params.cast("double")) >= 0.8)).otherwise(0.0)
    hits = hits + F.when(with_result, flag(documents_return)).otherwise(0.0)
    score = hits / (3.0 + with_params.cast("double") + with_result.cast("double"))
    return F.struct(score.alias("score"), doc_level(score).alias("level"), (score >= 0.5).alias("documented"))


# Deprecation marks by language.
DEPRECATION = {
    "typescript": r"(?i:@deprecated)", "javascript": r"(?i:@deprecated)", "java": r"(?i:@deprecated)",
    "python": r"warnings\.warn\s*\([^)]*DeprecationWarning|(?i:@deprecated|\.\.\s*deprecated::|:deprecated:)", "go": r"(?i://\s*Deprecated:)|Deprecated:",
    "csharp": r"\[Obsolete|\[Deprecated|(?i:///\s*<remarks>\s*Deprecated)", "cpp": r"\[\[deprecated|__attribute__\s*\(\s*\(\s*deprecated|(?i:@deprecated)|\\deprecated",
}


def is_deprecated(flag: Column, tags: Column, text: Column, language: Column, modifiers: Column | None = None) -> Column:
    """By the flag, else a tag, else the language's marks in the comment, else a modifier that says deprecated or obsolete."""
    marks = F.lit(False)
    for name, pattern in DEPRECATION.items():
        marks = marks | ((F.lower(language) == name) & text.rlike(pattern))
    said = F.lit(False) if modifiers is None else F.exists(modifiers, lambda m: F.lower(m).rlike("deprecated|obsolete"))
    tagged = F.exists(tags, lambda t: F.lower(t) == "deprecated")
    return F.coalesce(flag, F.lit(False)) | F.coalesce(tagged, F.lit(False)) | F.coalesce(marks, F.lit(False)) | F.coalesce(said, F.lit(False))


# Names that mark a shared component, the types by what a name contains, words of business domains, and names of cross-cutting concerns.
SHARED_NAMES = (
    r"(?i)Util(s)?$", r"(?i)Helper$", r"(?i)Converter$", r"(?i)Formatter$", r"(?i)Constants?$", r"(?i)Config(uration)?$", r"(?i)Common", r"^Base[A-Z]", r"^Abstract[A-Z]",
    r"(?i)Builder$", r"(?i)Factory$", r"(?i)Provider$", r"(?i)Adapter$", r"(?i)Handler$", r"(?i)Wrapper$",
)
SHARED_TYPES = (("(?i)util", "utility"), ("(?i)helper", "helper"), ("(?i)validator|validation", "validator"), ("(?i)converter", "converter"), ("(?i)formatter", "formatter"),
                ("(?i)constant", "constants"), ("^Base", "base"), ("^Abstract", "abstract"))
DOMAINS = {
    "point": ("point", "poi", "location", "coordinate"), "legalEntity": ("legalentity", "legal", "entity", "party", "company"), "meter": ("meter", "station", "measurement"),
    "contact": ("contact", "address", "phone", "email"), "survey": ("survey", "questionnaire", "form"), "edi": ("edi", "trading", "partner", "dataset"), "farmtap": ("farmtap", "farm", "tap", "region"),
}
CROSS_CUTTING = ("logger", "logging", "audit", "security", "auth", "cache", "transaction", "exception", "error", "message", "notification", "email", "validation")


def shared_component(name: Column, path: Column) -> Column:
    """struct(type, domains, cross_cutting) of a class whose name marks it as shared, else null. Domains
    are those with a word in the name or the path."""
    from codelattice.functions.ladders import first_match

    where = F.lower(F.concat_ws(" ", name, path))
    domains = F.array_compact(F.array(*(F.when(where.rlike("|".join(w)), F.lit(d)) for d, w in DOMAINS.items())))
    shared = name.rlike("|".join(f"({p})" for p in SHARED_NAMES))
    return F.when(shared, F.struct(
        first_match(name, SHARED_TYPES, "utility").alias("type"), domains.alias("domains"), F.lower(name).rlike("|".join(CROSS_CUTTING)).alias("cross_cutting")))
