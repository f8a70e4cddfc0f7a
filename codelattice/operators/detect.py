"""Detectors over source text: entry points, frameworks, tests. Rule tables become expressions, so one pass
over the rows tries all rules, without a join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelattice.functions.ladders import first_match

#: Kinds of nodes that can be entry points, and kinds that hold them.
CALLABLES = ("Function", "Method", "TSFunction", "JavaMethod", "GoFunction", "GoMethod", "CSharpMethod", "CppMethod", "CFunction")
HOLDERS = ("Class", "JavaClass", "CppClass", "CSharpClass", "GoStruct")
METHODS = ("GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS", "TRACE")


# Rules by family in the order in which they are tried; each is framework, detail (or the group that holds it),
# pattern and the group of the value (0: none). All ignore case.
ENTRY_RULES = {
    "rest": (
        ("Spring", "GET", r"@GetMapping\s*\(\s*[\"']?([^\"')]+)[\"']?\s*\)", 1),
        ("Spring", "POST", r"@PostMapping\s*\(\s*[\"']?([^\"')]+)[\"']?\s*\)", 1),
        ("Spring", "PUT", r"@PutMapping\s*\(\s*[\"']?([^\"')]+)[\"']?\s*\)", 1),
        ("Spring", "DELETE", r"@DeleteMapping\s*\(\s*[\"']?([^\"')]+)[\"']?\s*\)", 1),
        ("Spring", "PATCH", r"@PatchMapping\s*\(\s*[\"']?([^\"')]+)[\"']?\s*\)", 1),
        ("Spring", 2, r"@RequestMapping\s*\([^)]*value\s*=\s*[\"']([^\"']+)[\"'][^)]*method\s*=\s*RequestMethod\.(\w+)", 1),
        ("Spring", "GET", r"@RequestMapping\s*\(\s*[\"']([^\"']+)[\"']\s*\)", 1),
        ("NestJS", "GET", r"@Get\s*\(\s*['\"]?([^'\")\s]*)['\"]?\s*\)", 1),
        ("NestJS", "POST", r"@Post\s*\(\s*['\"]?([^'\")\s]*)['\"]?\s*\)", 1),
        ("NestJS", "PUT", r"@Put\s*\(\s*['\"]?([^'\")\s]*)['\"]?\s*\)", 1),
        ("NestJS", "DELETE", r"@Delete\s*\(\s*['\"]?([^'\")\s]*)['\"]?\s*\)", 1),
        ("NestJS", "PATCH", r"@Patch\s*\(\s*['\"]?([^'\")\s]*)['\"]?\s*\)", 1),
        ("FastAPI", "GET", r"@app\.get\s*\(\s*[\"']([^\"']+)[\"']", 1),
        ("FastAPI", "POST", r"@app\.post\s*\(\s*[\"']([^\"']+)[\"']", 1),
        ("FastAPI", "PUT", r"@app\.put\s*\(\s*[\"']([^\"']+)[\"']", 1),
        ("FastAPI", "DELETE", r"@app\.delete\s*\(\s*[\"']([^\"']+)[\"']", 1),
        ("FastAPI", "GET", r"@router\.get\s*\(\s*[\"']([^\"']+)[\"']", 1),
        ("FastAPI", "POST", r"@router\.post\s*\(\s*[\"']([^\"']+)[\"']", 1),
        ("Flask", 2, r"@app\.route\s*\(\s*[\"']([^\"']+)[\"'][^)]*methods\s*=\s*\[[\"'](\w+)[\"']", 1),
        ("Flask", "GET", r"@app\.route\s*\(\s*[\"']([^\"']+)[\"']\s*\)", 1),
        ("Flask", "GET", r"@blueprint\.route\s*\(\s*[\"']([^\"']+)[\"']", 1),
        ("Express", "GET", r"app\.get\s*\(\s*[\"']([^\"']+)[\"']", 1),
        ("Express", "POST", r"app\.post\s*\(\s*[\"']([^\"']+)[\"']", 1),
        ("Express", "PUT", r"app\.put\s*\(\s*[\"']([^\"']+)[\"']", 1),
        ("Express", "DELETE", r"app\.delete\s*\(\s*[\"']([^\"']+)[\"']", 1),
        ("Express", "GET", r"router\.get\s*\(\s*[\"']([^\"']+)[\"']", 1),
        ("Express", "POST", r"router\.post\s*\(\s*[\"']([^\"']+)[\"']", 1),
        ("Gin", "GET", r"\.GET\s*\(\s*[\"']([^\"']+)[\"']", 1),
        ("Gin", "POST", r"\.POST\s*\(\s*[\"']([^\"']+)[\"']", 1),
        ("Gin", "PUT", r"\.PUT\s*\(\s*[\"']([^\"']+)[\"']", 1),
        ("Gin", "DELETE", r"\.DELETE\s*\(\s*[\"']([^\"']+)[\"']", 1),
        ("ASP.NET", "GET", r"\[HttpGet\s*\(\s*[\"']?([^\"'\])]*)[\"']?\s*\)\]", 1),
        ("ASP.NET", "POST", r"\[HttpPost\s*\(\s*[\"']?([^\"'\])]*)[\"']?\s*\)\]", 1),
        ("ASP.NET", "PUT", r"\[HttpPut\s*\(\s*[\"']?([^\"'\])]*)[\"']?\s*\)\]", 1),
        ("ASP.NET", "DELETE", r"\[HttpDelete\s*\(\s*[\"']?([^\"'\])]*)[\"']?\s*\)\]", 1),
        ("ASP.NET", "GET", r"\[Route\s*\(\s*[\"']([^\"']+)[\"']\s*\)\]", 1),
        ("Django", "GET", r"path\s*\(\s*[\"']([^\"']+)[\"']", 1),
    ),
    "graphql": (
        ("Apollo", "Query", r"@Query\s*\(\s*\)\s*(?:async\s+)?(\w+)", 1),
        ("Apollo", "Mutation", r"@Mutation\s*\(\s*\)\s*(?:async\s+)?(\w+)", 1),
        ("Apollo", "Subscription", r"@Subscription\s*\(\s*\)\s*(?:async\s+)?(\w+)", 1),
        ("NestJS", "Query", r"@Query\s*\([^)]*\)\s*(?:async\s+)?(\w+)", 1),
        ("NestJS", "Mutation", r"@Mutation\s*\([^)]*\)\s*(?:async\s+)?(\w+)", 1),
        ("Spring", "Query", r"@QueryMapping\s*(?:\([^)]*\))?\s*(?:public\s+)?(?:\w+\s+)?(\w+)", 1),
        ("Spring", "Mutation", r"@MutationMapping\s*(?:\([^)]*\))?\s*(?:public\s+)?(?:\w+\s+)?(\w+)", 1),
        ("Spring", "Subscription", r"@SubscriptionMapping\s*(?:\([^)]*\))?\s*(?:public\s+)?(?:\w+\s+)?(\w+)", 1),
    ),
    "event": (
        ("Spring", "Spring Events", r"@EventListener\s*\(([^)]+)\)", 1),
        ("Spring", "Kafka", r"@KafkaListener\s*\([^)]*topics?\s*=\s*[\"']([^\"']+)[\"']", 1),
        ("Spring", "RabbitMQ", r"@RabbitListener\s*\([^)]*queues?\s*=\s*[\"']([^\"']+)[\"']", 1),
        ("Spring", "JMS", r"@JmsListener\s*\([^)]*destination\s*=\s*[\"']([^\"']+)[\"']", 1),
        ("Spring", "AWS SQS", r"@SqsListener\s*\([^)]*value\s*=\s*[\"']([^\"']+)[\"']", 1),
        ("Node.js", "EventEmitter", r"\.on\s*\(\s*['\"]([^'\"]+)['\"]", 1),
        ("Node.js", "EventEmitter", r"\.addEventListener\s*\(\s*['\"]([^'\"]+)['\"]", 1),
        ("Celery", "Celery", r"@(?:app\.)?task\s*\(", 0),
        ("Celery", "Celery", r"@shared_task\s*\(", 0),
        ("NestJS", "Microservice", r"@EventPattern\s*\(\s*['\"]([^'\"]+)['\"]", 1),
        ("NestJS", "Microservice", r"@MessagePattern\s*\(\s*['\"]([^'\"]+)['\"]", 1),
    ),
    "scheduled": (
        ("Spring", "cron", r"@Scheduled\s*\([^)]*cron\s*=\s*[\"']([^\"']+)[\"']", 1),
        ("Spring", "fixedRate", r"@Scheduled\s*\([^)]*fixedRate\s*=\s*(\d+)", 1),
        ("Spring", "fixedDelay", r"@Scheduled\s*\([^)]*fixedDelay\s*=\s*(\d+)", 1),
        ("NestJS", "cron", r"@Cron\s*\(\s*['\"]([^'\"]+)['\"]", 1),
        ("NestJS", "interval", r"@Interval\s*\(\s*(\d+)\s*\)", 1),
        ("APScheduler", "cron", r"@scheduler\.scheduled_job\s*\(\s*['\"]cron['\"]\s*,", 0),
        ("APScheduler", "interval", r"@scheduler\.scheduled_job\s*\(\s*['\"]interval['\"]\s*,", 0),
        ("Celery", "cron", r"schedule\s*=\s*crontab\s*\(", 0),
        ("Go", "cron", r"c\.AddFunc\s*\(\s*[\"']([^\"']+)[\"']", 1),
    ),
    "cli": (
        ("Spring", "", r"implements\s+CommandLineRunner", 0),
        ("Spring", "", r"implements\s+ApplicationRunner", 0),
        ("Click", "", r"@click\.command\s*\(\s*(?:['\"]([^'\"]+)['\"])?\s*\)", 1),
        ("Click", "", r"@click\.group\s*\(\s*(?:['\"]([^'\"]+)['\"])?\s*\)", 1),
        ("argparse", "", r"parser\.add_subparsers\s*\(", 0),
        ("argparse", "", r"add_parser\s*\(\s*['\"]([^'\"]+)['\"]", 1),
        ("Commander", "", r"\.command\s*\(\s*['\"]([^'\"]+)['\"]", 1),
        ("Commander", "", r"program\.name\s*\(\s*['\"]([^'\"]+)['\"]", 1),
        ("Cobra", "", r"&cobra\.Command\s*\{\s*Use:\s*[\"']([^\"']+)[\"']", 1),
    ),
}
# Where a controller states its base path, in order, and the edge from a handler to its entry point.
BASE_PATHS = (r"@RequestMapping\s*\(\s*[\"']([^\"']+)[\"']\s*\)", r"@RequestMapping\s*\([^)]*value\s*=\s*[\"']([^\"']+)[\"']", r"@Controller\s*\(\s*[\"']([^\"']+)[\"']\s*\)",
              r"@RestController\s*\(\s*[\"']([^\"']+)[\"']\s*\)")
ENTRY_EDGES = {"rest": "EXPOSES_ENDPOINT", "graphql": "RESOLVES_OPERATION", "event": "HANDLES_EVENT", "scheduled": "SCHEDULED_BY", "cli": "INVOKED_BY_CLI"}


def _group(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _entry(family: str, text: Column, name: Column) -> Column:
    """The first rule of a family that is found in a text, as a struct, else null."""
    hits = []
    for framework, detail, pattern, group in ENTRY_RULES[family]:
        p = f"(?i){pattern}"
        said = F.upper(F.regexp_extract(text, p, detail)) if isinstance(detail, int) else F.lit(detail)
        said = F.when(said.isin(*METHODS), said).otherwise("GET") if isinstance(detail, int) else said
        missing = F.lit("/") if family == "rest" else F.lit(None).cast("string") if family == "scheduled" else name
        value = F.coalesce(_group(text, p, group), missing) if group else missing if family != "rest" else F.lit("/")
        hits.append(F.when(text.rlike(p), F.struct(F.lit(family).alias("family"), F.lit(framework).alias("framework"), said.alias("detail"), value.alias("value"))))
    return F.coalesce(*hits)


def entry_points(nodes: DataFrame) -> DataFrame:
    """(id, parent_id, family, framework, detail, value, path, parameters, edge) of nodes (id, parent_id, kind, name, text).

    Functions and methods are tried against each family by itself; within a family the first rule counts.
    ``detail`` is the HTTP method, the operation, the source of events or the kind of schedule; ``value``
    the path, name, event, schedule or command (a name where the rule gives none). A REST path
    continues the base path of the class it belongs to. ``text`` is the node's own text with the lines
    before it that hold its annotations.
    """
    found = F.array_compact(F.array(*(_entry(f, F.col("text"), F.col("name")) for f in ENTRY_RULES)))
    rows = nodes.where(F.col("kind").isin(*CALLABLES)).select("id", "parent_id", F.inline(found))
    base = F.coalesce(*(_group(F.col("text"), f"(?i){p}", 1) for p in BASE_PATHS))
    bases = nodes.where(F.col("kind").isin(*HOLDERS)).select(F.col("id").alias("holder"), base.alias("base")).where("base is not null")
    edge = F.element_at(F.create_map(*(F.lit(x) for kv in ENTRY_EDGES.items() for x in kv)), F.col("family"))
    whole = F.when(F.col("family") == "rest", F.when(F.col("base").isNull(), F.when(F.col("value").startswith("/"), F.col("value")).otherwise(F.concat(F.lit("/"), "value"))).otherwise(
        F.concat(F.regexp_replace("base", "/$", ""), F.when(F.col("value").startswith("/"), F.col("value")).otherwise(F.concat(F.lit("/"), "value")))))
    named = F.regexp_extract_all("path", F.lit(r"(\{\w+\}|:\w+|<\w+>)"), F.lit(1))
    return rows.join(bases, F.col("parent_id") == F.col("holder"), "left").withColumn("path", whole).select(
        "id", "parent_id", "family", "framework", "detail", "value", "path", F.transform(named, lambda x: F.regexp_replace(x, r"[{}:<>]", "")).alias("parameters"), edge.alias("edge"))


# Frameworks by the manifest that names their packages: framework, category, confidence, packages.
MANIFESTS = {
    "package.json": (
        ("Express", "backend", 0.95, ("express",)),
        ("NestJS", "backend", 0.95, ("@nestjs/core", "@nestjs/common")),
        ("Fastify", "backend", 0.95, ("fastify",)),
        ("Koa", "backend", 0.95, ("koa",)),
        ("Hapi", "backend", 0.95, ("@hapi/hapi",)),
        ("React", "frontend", 0.95, ("react", "react-dom")),
        ("Next.js", "frontend", 0.95, ("next",)),
        ("Vue", "frontend", 0.95, ("vue",)),
        ("Nuxt", "frontend", 0.95, ("nuxt", "nuxt3")),
        ("Angular", "frontend", 0.95, ("@angular/core",)),
        ("Svelte", "frontend", 0.95, ("svelte",)),
        ("SvelteKit", "frontend", 0.95, ("@sveltejs/kit",)),
        ("Jest", "testing", 0.95, ("jest", "@jest/core")),
        ("Mocha", "testing", 0.95, ("mocha",)),
        ("Vitest", "testing", 0.95, ("vitest",)),
        ("Jasmine", "testing", 0.95, ("jasmine", "jasmine-core")),
        ("Cypress", "testing", 0.95, ("cypress",)),
        ("Playwright", "testing", 0.95, ("@playwright/test", "playwright")),
        ("Prisma", "database", 0.95, ("@prisma/client", "prisma")),
        ("TypeORM", "database", 0.95, ("typeorm",)),
        ("Sequelize", "database", 0.95, ("sequelize",)),
        ("Mongoose", "database", 0.95, ("mongoose",)),
        ("Bull", "messaging", 0.9, ("bull", "bullmq")),
        ("KafkaJS", "messaging", 0.9, ("kafkajs",)),
        ("AMQP", "messaging", 0.9, ("amqplib",)),
    ),
    "pom.xml": (
        ("Spring Boot", "backend", 0.95, ("spring-boot-starter", "spring-boot-starter-web")),
        ("Spring MVC", "backend", 0.9, ("spring-webmvc",)),
        ("Spring WebFlux", "backend", 0.95, ("spring-boot-starter-webflux",)),
        ("Quarkus", "backend", 0.95, ("quarkus-core", "io.quarkus")),
        ("Micronaut", "backend", 0.95, ("micronaut-core", "io.micronaut")),
        ("Jakarta EE", "backend", 0.85, ("jakarta.platform", "javax.servlet")),
        ("JUnit5", "testing", 0.95, ("junit-jupiter", "org.junit.jupiter")),
        ("JUnit", "testing", 0.95, ("junit", "junit:junit")),
        ("TestNG", "testing", 0.95, ("testng", "org.testng")),
        ("Mockito", "testing", 0.9, ("mockito-core", "org.mockito")),
        ("Hibernate", "database", 0.95, ("hibernate-core", "org.hibernate")),
        ("MyBatis", "database", 0.95, ("mybatis", "org.mybatis")),
        ("Spring Data JPA", "database", 0.95, ("spring-boot-starter-data-jpa",)),
        ("Spring Kafka", "messaging", 0.9, ("spring-kafka",)),
        ("Spring AMQP", "messaging", 0.9, ("spring-amqp", "spring-rabbit")),
    ),
    "build.gradle": (
        ("Spring Boot", "backend", 0.95, ("org.springframework.boot", "spring-boot-starter")),
        ("Quarkus", "backend", 0.95, ("io.quarkus",)),
        ("Micronaut", "backend", 0.95, ("io.micronaut",)),
        ("JUnit5", "testing", 0.95, ("org.junit.jupiter", "junit-jupiter")),
        ("JUnit", "testing", 0.95, ("junit:junit",)),
        ("Spock", "testing", 0.95, ("org.spockframework", "spock-core")),
    ),
    "requirements.txt": (
        ("FastAPI", "backend", 0.95, ("fastapi",)),
        ("Django", "backend", 0.95, ("django",)),
        ("Flask", "backend", 0.95, ("flask",)),
        ("Tornado", "backend", 0.95, ("tornado",)),
        ("Sanic", "backend", 0.95, ("sanic",)),
        ("aiohttp", "backend", 0.9, ("aiohttp",)),
        ("pytest", "testing", 0.95, ("pytest",)),
        ("unittest", "testing", 0.85, ("unittest2",)),
        ("nose", "testing", 0.9, ("nose", "nose2")),
        ("SQLAlchemy", "database", 0.95, ("sqlalchemy",)),
        ("Django ORM", "database", 0.8, ("django",)),
        ("Tortoise ORM", "database", 0.95, ("tortoise-orm",)),
        ("Celery", "messaging", 0.95, ("celery",)),
        ("kafka-python", "messaging", 0.9, ("kafka-python",)),
    ),
    "go.mod": (
        ("Go testing", "testing", 0.8, ("module ",)),
        ("Gin", "backend", 0.95, ("github.com/gin-gonic/gin",)),
        ("Echo", "backend", 0.95, ("github.com/labstack/echo",)),
        ("Fiber", "backend", 0.95, ("github.com/gofiber/fiber",)),
        ("Chi", "backend", 0.95, ("github.com/go-chi/chi",)),
        ("Gorilla Mux", "backend", 0.95, ("github.com/gorilla/mux",)),
        ("Testify", "testing", 0.9, ("github.com/stretchr/testify",)),
        ("Ginkgo", "testing", 0.95, ("github.com/onsi/ginkgo",)),
        ("GoMock", "testing", 0.9, ("github.com/golang/mock",)),
        ("GORM", "database", 0.95, ("gorm.io/gorm",)),
        ("sqlx", "database", 0.9, ("github.com/jmoiron/sqlx",)),
    ),
    ".csproj": (
        ("ASP.NET Core", "backend", 0.95, ("Microsoft.AspNetCore", "Microsoft.AspNetCore.App")),
        ("ASP.NET Core MVC", "backend", 0.95, ("Microsoft.AspNetCore.Mvc",)),
        ("Blazor", "frontend", 0.95, ("Microsoft.AspNetCore.Components",)),
        ("xUnit", "testing", 0.95, ("xunit", "xunit.core")),
        ("NUnit", "testing", 0.95, ("NUnit", "NUnit3TestAdapter")),
        ("MSTest", "testing", 0.95, ("MSTest.TestFramework", "Microsoft.VisualStudio.TestPlatform")),
        ("Moq", "testing", 0.9, ("Moq",)),
        ("Entity Framework Core", "database", 0.95, ("Microsoft.EntityFrameworkCore",)),
        ("Dapper", "database", 0.95, ("Dapper",)),
    ),
}
# Frameworks by patterns in source text: framework, category, confidence, patterns (imports, annotations, content).
CODE_PATTERNS = (
    ("Spring Boot", "backend", 0.9, (r"import\s+org\.springframework", "@SpringBootApplication", "@RestController", "@Controller", "@Service", "@Repository", "@Component")),
    ("NestJS", "backend", 0.9, (r"from\s+['\"]@nestjs/", r"@Controller\s*\(", r"@Injectable\s*\(", r"@Module\s*\(", r"@Get\s*\(", r"@Post\s*\(")),
    ("Express", "backend", 0.85, (r"require\s*\(\s*['\"]express['\"]\s*\)", r"from\s+['\"]express['\"]", r"express\s*\(\s*\)", r"app\.(get|post|put|delete|patch)\s*\(", r"router\.(get|post|put|delete|patch)\s*\(")),
    ("FastAPI", "backend", 0.9, (r"from\s+fastapi\s+import", r"import\s+fastapi", r"@app\.(get|post|put|delete|patch)\s*\(", r"@router\.(get|post|put|delete|patch)\s*\(")),
    ("Django", "backend", 0.9, (r"from\s+django", r"import\s+django", r"urlpatterns\s*=", r"class\s+\w+\(.*View\)")),
    ("Flask", "backend", 0.9, (r"from\s+flask\s+import", r"import\s+flask", r"@app\.route\s*\(", r"@blueprint\.route\s*\(")),
    ("React", "frontend", 0.85, (r"from\s+['\"]react['\"]", r"import\s+React", r"React\.createElement", r"useState\s*\(", r"useEffect\s*\(", r"<[A-Z][a-zA-Z]*[\s/>]")),
    ("Angular", "frontend", 0.9, (r"from\s+['\"]@angular/", r"@Component\s*\(", r"@NgModule\s*\(", r"@Injectable\s*\(")),
    ("Vue", "frontend", 0.85, (r"from\s+['\"]vue['\"]", r"createApp\s*\(", r"defineComponent\s*\(", "<template>", r"<script\s+setup")),
    ("Gin", "backend", 0.9, (r"\"github\.com/gin-gonic/gin\"", r"gin\.Default\s*\(\)", r"gin\.New\s*\(\)", r"\.GET\s*\(", r"\.POST\s*\(")),
    ("ASP.NET Core", "backend", 0.9, (r"using\s+Microsoft\.AspNetCore", r"\[ApiController\]", r"\[Route\s*\(", r"\[HttpGet", r"\[HttpPost")),
)


def _manifest_hits(kind: str, text: Column) -> list[Column]:
    """For each framework of a kind of manifest a struct if one of its packages is named, else null."""
    low = F.lower(text)
    names = F.flatten(F.array(*(F.coalesce(F.map_keys(F.from_json(F.get_json_object(text, f"$.{x}"), "map<string,string>")), F.array().cast("array<string>"))
                                for x in ("dependencies", "devDependencies", "peerDependencies"))))
    lines = F.transform(F.split(low, "\n"), lambda x: F.trim(x))

    def named(package: str) -> Column:
        if kind == "package.json":
            return F.array_contains(names, package)
        if kind == "requirements.txt":
            return F.exists(lines, lambda x: x.startswith(package) | x.contains(f"{package}==") | x.contains(f"{package}>="))
        if kind == "pyproject.toml":
            return F.contains(low, F.lit(package))
        return F.contains(text, F.lit(package))

    share = 0.9 if kind == "pyproject.toml" else 1.0  # a package that is only mentioned
    out = []
    for framework, category, confidence, packages in MANIFESTS["requirements.txt" if kind == "pyproject.toml" else kind]:
        have = F.array_compact(F.array(*(F.when(named(p), F.lit(p)) for p in packages)))
        out.append(F.when(F.size(have) > 0, F.struct(
            F.lit(framework).alias("framework"), F.lit(category).alias("category"), F.lit(round(confidence * share, 9)).alias("confidence"),
            F.concat(F.lit(f"{kind}: "), F.array_join(F.transform(have, lambda x: F.trim(x)), ", ")).alias("evidence"))))
    return out


def frameworks_by_manifest(manifests: DataFrame) -> DataFrame:
    """(framework, category, confidence, evidence) from manifests (path, text), a row for each that names the framework."""
    none = F.array().cast("array<struct<framework: string, category: string, confidence: double, evidence: string>>")
    found = none
    for kind in (*MANIFESTS, "pyproject.toml"):
        found = F.when(F.col("path").endswith(kind), F.coalesce(F.array_compact(F.array(*_manifest_hits(kind, F.col("text")))), none)).otherwise(found)
    return manifests.select(F.inline(found))


def frameworks_by_code(texts: DataFrame, text: str = "text") -> DataFrame:
    """(framework, category, confidence, evidence) from source texts: the confidence grows by 0.05 with each
    further pattern that is found, to 1 at most."""
    def hit(framework: str, category: str, confidence: float, patterns: Sequence[str]) -> Column:
        k = sum((F.col(text).rlike(p).cast("int") for p in patterns), F.lit(0))
        return F.when(k > 0, F.struct(
            F.lit(framework).alias("framework"), F.lit(category).alias("category"), F.round(F.least(F.lit(1.0), confidence + (k - 1) * 0.05), 9).alias("confidence"),
            F.concat(F.lit("code: "), k.cast("string")).alias("evidence")))

    return texts.select(F.inline(F.array_compact(F.array(*(hit(*r) for r in CODE_PATTERNS)))))


def frameworks(manifests: DataFrame, texts: DataFrame) -> DataFrame:
    """(framework, category, confidence, evidence): all finds of a framework together, with the largest
    confidence and the distinct evidence."""
    every = frameworks_by_manifest(manifests).unionByName(frameworks_by_code(texts))
    return every.groupBy("framework").agg(F.min("category").alias("category"), F.max("confidence").alias("confidence"), F.array_sort(F.collect_set("evidence")).alias("evidence"))


# Test files by path (framework, priority, pattern; the first of the highest priority counts), then by content.
TEST_PATHS = (
    ("JUnit", 2, r"Test\.java$"), ("JUnit", 2, r"Tests\.java$"), ("JUnit", 1, r"IT\.java$"), ("JUnit", 1, r"Spec\.java$"), ("JUnit", 1, "src/test/java/"),
    ("Jest", 3, r"\.test\.[jt]sx?$"), ("Jest", 3, r"\.spec\.[jt]sx?$"), ("Jest", 2, r"__tests__/.*\.[jt]sx?$"), ("Mocha", 1, r"test/.*\.[jt]sx?$"), ("Mocha", 1, r"tests/.*\.[jt]sx?$"), ("Vitest", 2, r"\.test\.[jt]sx?$"),
    ("pytest", 3, r"test_.*\.py$"), ("pytest", 3, r"_test\.py$"), ("pytest", 2, r"tests/.*\.py$"), ("pytest", 2, r"test/.*\.py$"), ("Go testing", 3, r"_test\.go$"),
    ("xUnit", 2, r"Tests?\.cs$"), ("xUnit", 2, r"\.Tests?/.*\.cs$"), ("NUnit", 1, r"Spec\.cs$"), ("GoogleTest", 2, r"_test\.cpp$"), ("GoogleTest", 2, r"_test\.cc$"), ("GoogleTest", 2, r"test_.*\.cpp$"),
)
TEST_IMPORTS = (
    ("Jest", r"import.*['\"]@jest/globals['\"]|from\s+['\"]jest['\"]|require\(['\"]jest['\"]\)"), ("Vitest", r"import.*['\"]vitest['\"]|from\s+['\"]vitest['\"]"), ("Mocha", r"import.*['\"]mocha['\"]|require\(['\"]mocha['\"]\)"),
    ("JUnit", r"import\s+org\.junit"), ("JUnit5", r"import\s+org\.junit\.jupiter"), ("pytest", r"import\s+pytest|from\s+pytest"), ("Go testing", r"import\s+\"testing\""), ("xUnit", r"using\s+Xunit|using\s+xUnit"),
    ("NUnit", r"using\s+NUnit"), ("MSTest", r"using\s+Microsoft\.VisualStudio\.TestTools"), ("GoogleTest", r"#include\s*[<\"]gtest/gtest\.h[>\"]"), ("Catch2", r"#include\s*[<\"]catch2"),
)
# What a line of a test file declares: the frameworks of files that a rule is for, pattern, group of the suite and of the case (0: none).
TEST_LINES = (
    (("JUnit5", "JUnit"), r"@Test\s+(?:public\s+)?void\s+(\w+)", 0, 1),
    (("JUnit5", "JUnit"), r"@ParameterizedTest[^@]*@\w+\s+(?:public\s+)?void\s+(\w+)", 0, 1),
    (("JUnit5", "JUnit"), r"@RepeatedTest\s*\([^)]*\)\s+(?:public\s+)?void\s+(\w+)", 0, 1),
    (("JUnit5", "JUnit"), r"@Nested\s+class\s+(\w+)", 1, 0),
    (("JUnit", "JUnit5"), r"@Test\s+public\s+void\s+(\w+)", 0, 1),
    (("Jest", "Vitest", "Mocha"), r"(?:it|test)\s*\(\s*['\"`]([^'\"`]+)['\"`]", 0, 1),
    (("Jest", "Vitest", "Mocha"), r"describe\s*\(\s*['\"`]([^'\"`]+)['\"`]", 1, 0),
    (("Mocha", "Jest", "Vitest"), r"(?:it|test)\s*\(\s*['\"`]([^'\"`]+)['\"`]", 0, 1),
    (("Mocha", "Jest", "Vitest"), r"describe\s*\(\s*['\"`]([^'\"`]+)['\"`]", 1, 0),
    (("Vitest", "Jest"), r"(?:it|test)\s*\(\s*['\"`]([^'\"`]+)['\"`]", 0, 1),
    (("pytest",), r"def\s+(test_\w+)\s*\(", 0, 1),
    (("pytest",), r"class\s+(Test\w+)\s*[:(]", 1, 0),
    (("Go testing",), r"func\s+(Test\w+)\s*\(\s*t\s+\*testing\.T\s*\)", 0, 1),
    (("Go testing",), r"func\s+(Benchmark\w+)\s*\(\s*b\s+\*testing\.B\s*\)", 0, 1),
    (("xUnit",), r"\[Fact\]\s*(?:public\s+)?(?:async\s+)?(?:Task|void)\s+(\w+)", 0, 1),
    (("xUnit",), r"\[Theory\][^\[]*\[(?:Inline|Member|Class)Data[^\]]*\]\s*(?:public\s+)?(?:async\s+)?(?:Task|void)\s+(\w+)", 0, 1),
    (("NUnit",), r"\[Test\]\s*(?:public\s+)?(?:async\s+)?(?:Task|void)\s+(\w+)", 0, 1),
    (("NUnit",), r"\[TestCase[^\]]*\]\s*(?:public\s+)?(?:async\s+)?(?:Task|void)\s+(\w+)", 0, 1),
    (("NUnit",), r"\[TestFixture\]\s*(?:public\s+)?class\s+(\w+)", 1, 0),
    (("GoogleTest",), r"TEST\s*\(\s*(\w+)\s*,\s*(\w+)\s*\)", 1, 2),
    (("GoogleTest",), r"TEST_F\s*\(\s*(\w+)\s*,\s*(\w+)\s*\)", 1, 2),
)
SKIPPED = r"\.skip\s*\(|xit\s*\(|xdescribe\s*\(|xtest\s*\(|@Ignore|@Disabled|\[Ignore\]|\[Skip\]|@pytest\.mark\.skip|t\.Skip\("
FOCUSED = r"\.only\s*\(|fit\s*\(|fdescribe\s*\(|test\.only\s*\("
SETUP = r"beforeEach\s*\(|beforeAll\s*\(|@Before|\[SetUp\]|\[OneTimeSetUp\]|def\s+setUp\s*\(|def\s+setup_method\s*\(|func\s+SetUp\w*\s*\("
TEARDOWN = r"afterEach\s*\(|afterAll\s*\(|@After|\[TearDown\]|\[OneTimeTearDown\]|def\s+tearDown\s*\(|def\s+teardown_method\s*\(|func\s+TearDown\w*\s*\("
MOCKS = (("Jest", r"jest\.mock|jest\.fn|jest\.spyOn"), ("Vitest", r"vi\.mock|vi\.fn|vi\.spyOn"), ("Sinon", r"sinon\.|createStub|createSpy"), ("Mockito", r"@Mock|@InjectMocks|Mockito\."),
         ("unittest.mock", r"unittest\.mock|@patch|MagicMock"), ("pytest fixtures", r"pytest\.fixture"), ("Moq", r"moq\.|Mock<|It\.Is"), ("NSubstitute", r"NSubstitute|Substitute\.For"), ("GoMock", r"gomock\.|ctrl\.EXPECT"))
TEST_TYPES = {"unit": "unit", "integration": r"integration|IT\.java$|@SpringBootTest|@DataJpaTest|@WebMvcTest", "e2e": "e2e|end-to-end|cypress|playwright|puppeteer|selenium"}
# A test's path to that of what it tests; the first that fits is applied.
TESTED = ((r"Test\.java$", ".java"), (r"Tests\.java$", ".java"), (r"IT\.java$", ".java"), (r"\.test\.(tsx?)$", ".$1"), (r"\.spec\.(tsx?)$", ".$1"), (r"test_(.+)\.py$", "$1.py"), (r"(.+)_test\.py$", "$1.py"),
          (r"_test\.go$", ".go"), (r"Tests?\.cs$", ".cs"))


def tested_path(path: Column) -> Column:
    """The source path that a test's path stands for, else null; test folders become source folders."""
    out = first_match(path, [(p, F.regexp_replace(path, p, to)) for p, to in TESTED])
    once = lambda c, a, b: F.regexp_replace(c, f"^(.*?){a}(.*)$", f"$1{b}$2")
    return once(once(once(once(out, "/test/", "/main/"), "/__tests__/", "/"), "/tests/", "/src/"), "/test/", "/src/")


def test_framework(path: Column, text: Column) -> Column:
    """The framework of a test file, by its path or else its imports, refined by its content; null for other files."""
    by_path = first_match(path, [(f"(?i){p}", f) for f, _, p in sorted(TEST_PATHS, key=lambda r: -r[1])])
    known = F.coalesce(by_path, first_match(text, [(f"(?i){p}", f) for f, p in TEST_IMPORTS]))
    junit = known == "JUnit"
    return F.when(junit & text.rlike("@DisplayName|@Nested|@ParameterizedTest|@RepeatedTest"), "JUnit5").when(junit & text.rlike(r"@Test\s*\([^)]*groups\s*="), "TestNG").otherwise(known)


def test_cases(files: DataFrame) -> DataFrame:
    """(path, framework, line, rule, suite, case, opens_suite, skipped, focused): what the lines of test files (path, text) declare.

    Each rule that fits a line and the file's framework gives a row. A case belongs to the suite that
    was declared last; lines are rows, so no array grows with the file.
    """
    known = files.withColumn("framework", test_framework(F.col("path"), F.coalesce("text", F.lit("")))).where("framework is not null")
    lines = known.select("path", "framework", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("at", "code"))
    w = Window.partitionBy("path").orderBy("at")
    lines = lines.withColumn("before", F.coalesce(F.lag("code").over(w), F.lit("")))

    def hit(n: int, rule: tuple) -> Column:
        fits, pattern, suite, case = rule
        p = f"(?i){pattern}"
        get = lambda g: _group(F.col("code"), p, g) if g else F.lit(None).cast("string")
        return F.when(F.col("framework").isin(*fits) & F.col("code").rlike(p), F.struct(F.lit(n).alias("rule"), get(suite).alias("opens_suite"), get(case).alias("case")))

    found = lines.select("path", "framework", (F.col("at") + 1).alias("line"), "code", "before", F.inline(F.array_compact(F.array(*(hit(n, r) for n, r in enumerate(TEST_LINES))))))
    open_ = Window.partitionBy("path").orderBy("line", "rule").rowsBetween(Window.unboundedPreceding, 0)
    return found.select(
        "path", "framework", "line", "rule", F.last("opens_suite", ignorenulls=True).over(open_).alias("suite"), "case", "opens_suite",
        F.concat_ws("\n", "before", "code").rlike(SKIPPED).alias("skipped"), F.col("code").rlike(FOCUSED).alias("focused"))


def test_files(files: DataFrame) -> DataFrame:
    """(path, framework, n_cases, n_suites, tested, unit, integration, e2e, setup, teardown, mocks) of test files (path, text)."""
    text = F.coalesce("text", F.lit(""))
    whole = F.concat(F.col("path"), F.lit("\n"), text)
    rows = files.withColumn("framework", test_framework(F.col("path"), text)).where("framework is not null")
    kind = lambda k: whole.rlike(f"(?i){TEST_TYPES[k]}").alias(k)
    rows = rows.select(
        "path", "framework", tested_path(F.col("path")).alias("tested"), *map(kind, TEST_TYPES), text.rlike(SETUP).alias("setup"), text.rlike(TEARDOWN).alias("teardown"),
        F.array_compact(F.array(*(F.when(text.rlike(f"(?i){p}"), F.lit(m)) for m, p in MOCKS))).alias("mocks"))
    counts = test_cases(files).groupBy(F.col("path").alias("own")).agg(F.count("case").alias("n_cases"), F.count_distinct("opens_suite").alias("n_suites"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return rows.join(counts, F.col("path") == F.col("own"), "left").select("path", "framework", zero("n_cases"), zero("n_suites"), "tested", *TEST_TYPES, "setup", "teardown", "mocks")

