"""One case for each rule of the entry points and each framework of the manifests; every part is one of the cases by its key, and the SQL has the typed outcomes."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelattice.operators import detect
from codelattice.plans.code_queries import _FRAMEWORKS, _MANIFESTS, pick
from codelattice.plans.table_queries import query

QUERIES, ORACLES = {}, {}  # these register with the table queries

#: Text, family, framework, detail and value, a case for each rule in the order in which they are tried.
ENTRY_CASES = (
    ('@GetMapping("/a")', "rest", "Spring", "GET", "/a"), ('@PostMapping("/b")', "rest", "Spring", "POST", "/b"), ("@PutMapping('/c')", "rest", "Spring", "PUT", "/c"), ('@DeleteMapping("/d/{id}")', "rest", "Spring", "DELETE", "/d/{id}"), ('@PatchMapping( "/e" )', "rest", "Spring", "PATCH", "/e"),
    ('@RequestMapping(value = "/f", method = RequestMethod.PUT)', "rest", "Spring", "PUT", "/f"), ('@RequestMapping("/g")', "rest", "Spring", "GET", "/g"), ("@Get('h')", "rest", "NestJS", "GET", "h"), ("@Post('i')", "rest", "NestJS", "POST", "i"), ("@Put('j')", "rest", "NestJS", "PUT", "j"),
    ("@Delete(':k')", "rest", "NestJS", "DELETE", ":k"), ("@Patch()", "rest", "NestJS", "PATCH", "/"), ('@app.get("/l")', "rest", "FastAPI", "GET", "/l"), ('@app.post("/m")', "rest", "FastAPI", "POST", "/m"), ('@app.put("/n")', "rest", "FastAPI", "PUT", "/n"), ('@app.delete("/o")', "rest", "FastAPI", "DELETE", "/o"),
    ('@router.get("/p")', "rest", "FastAPI", "GET", "/p"), ('@router.post("/q")', "rest", "FastAPI", "POST", "/q"), ('@app.route("/r", methods=["DELETE"])', "rest", "Flask", "DELETE", "/r"), ('@app.route("/s")', "rest", "Flask", "GET", "/s"), ('@blueprint.route("/t", strict=1)', "rest", "Flask", "GET", "/t"),
    ("app.get('/u', f)", "rest", "Express", "GET", "/u"), ("app.post('/v', f)", "rest", "Express", "POST", "/v"), ("app.put('/w', f)", "rest", "Express", "PUT", "/w"), ("app.delete('/x', f)", "rest", "Express", "DELETE", "/x"), ("router.get('/y', f)", "rest", "Express", "GET", "/y"), ("router.post('/z', f)", "rest", "Express", "POST", "/z"),
    ('g.GET("/aa", h)', "rest", "Gin", "GET", "/aa"), ('g.POST("/bb", h)', "rest", "Gin", "POST", "/bb"), ('g.PUT("/cc", h)', "rest", "Gin", "PUT", "/cc"), ('g.DELETE("/dd", h)', "rest", "Gin", "DELETE", "/dd"), ('[HttpGet("ee")]', "rest", "ASP.NET", "GET", "ee"), ('[HttpPost("ff")]', "rest", "ASP.NET", "POST", "ff"),
    ('[HttpPut("gg")]', "rest", "ASP.NET", "PUT", "gg"), ('[HttpDelete("hh")]', "rest", "ASP.NET", "DELETE", "hh"), ('[Route("ii")]', "rest", "ASP.NET", "GET", "ii"), ("path('jj/<int>', v)", "rest", "Django", "GET", "jj/<int>"),
    ("@Query() async books", "graphql", "Apollo", "Query", "books"), ("@Mutation() add", "graphql", "Apollo", "Mutation", "add"), ("@Subscription() added", "graphql", "Apollo", "Subscription", "added"), ("@Query(of => Book) book", "graphql", "NestJS", "Query", "book"), ("@Mutation(of => Book) make", "graphql", "NestJS", "Mutation", "make"),
    ("@QueryMapping public Book one(", "graphql", "Spring", "Query", "one"), ("@MutationMapping Book two(", "graphql", "Spring", "Mutation", "two"), ('@SubscriptionMapping("x") Flux three(', "graphql", "Spring", "Subscription", "three"),
    ("@EventListener(Paid.class)", "event", "Spring", "Spring Events", "Paid.class"), ('@KafkaListener(topics = "orders")', "event", "Spring", "Kafka", "orders"), ('@RabbitListener(queues = "mail")', "event", "Spring", "RabbitMQ", "mail"), ('@JmsListener(destination = "box")', "event", "Spring", "JMS", "box"),
    ('@SqsListener(value = "q")', "event", "Spring", "AWS SQS", "q"), ("bus.on('paid', f)", "event", "Node.js", "EventEmitter", "paid"), ("w.addEventListener('load', f)", "event", "Node.js", "EventEmitter", "load"), ("@app.task(bind=True)", "event", "Celery", "Celery", "run"), ("@shared_task()", "event", "Celery", "Celery", "run"),
    ("@EventPattern('made')", "event", "NestJS", "Microservice", "made"), ("@MessagePattern('sum')", "event", "NestJS", "Microservice", "sum"), ('@Scheduled(cron = "0 1 * * *")', "scheduled", "Spring", "cron", "0 1 * * *"), ("@Scheduled(fixedRate = 500)", "scheduled", "Spring", "fixedRate", "500"),
    ("@Scheduled(fixedDelay = 90)", "scheduled", "Spring", "fixedDelay", "90"), ("@Cron('5 4 * * *')", "scheduled", "NestJS", "cron", "5 4 * * *"), ("@Interval(1000)", "scheduled", "NestJS", "interval", "1000"), ("@scheduler.scheduled_job('cron', hour=3)", "scheduled", "APScheduler", "cron", None),
    ("@scheduler.scheduled_job('interval', hours=3)", "scheduled", "APScheduler", "interval", None), ("schedule = crontab(minute=0)", "scheduled", "Celery", "cron", None), ('c.AddFunc("@daily", f)', "scheduled", "Go", "cron", "@daily"), ("class J implements CommandLineRunner", "cli", "Spring", "", "run"),
    ("class K implements ApplicationRunner", "cli", "Spring", "", "run"), ("@click.command('ls')", "cli", "Click", "", "ls"), ("@click.group()", "cli", "Click", "", "run"), ("parser.add_subparsers(dest=1)", "cli", "argparse", "", "run"), ("s.add_parser('up')", "cli", "argparse", "", "up"),
    ("program.command('go')", "cli", "Commander", "", "go"), ("program.name('tool')", "cli", "Commander", "", "tool"), ('&cobra.Command{Use: "serve"}', "cli", "Cobra", "", "serve"),
)


def _sql(x) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, int | float) else "'" + x.replace("'", "''") + "'"


_ENTRY_SQL = "c(m, family, framework, detail, value) AS (VALUES " + ", ".join("(" + ", ".join(map(_sql, (n, *case[1:]))) + ")" for n, case in enumerate(ENTRY_CASES)) + ")"


@query("d_entry_rules", f"WITH {_ENTRY_SQL} SELECT p_partkey AS id, family, framework, detail, value, CASE WHEN family = 'rest' THEN CASE WHEN starts_with(value, '/') THEN value ELSE '/' || value END END AS path FROM part JOIN c ON p_partkey % {len(ENTRY_CASES)} = m")
def _(t):
    """All 74 rules: each part is a method whose text is one rule's case."""
    nodes = t("part").select(F.col("p_partkey").alias("id"), F.lit(None).cast("bigint").alias("parent_id"), F.lit("Method").alias("kind"), F.lit("run").alias("name"), pick([c[0] for c in ENTRY_CASES]).alias("text"))
    return detect.entry_points(nodes).select("id", "family", "framework", "detail", "value", "path")


#: The frameworks that the manifests of the detector's queries name, by manifest.
_NAMED = tuple((n, f[0]) for n, (name, _) in enumerate(_MANIFESTS) for f in _FRAMEWORKS if f"{name.removeprefix('app')}: " in f[3])


@query("d_framework_counts", "WITH c(m, framework) AS (VALUES " + ", ".join(f"({m}, {_sql(f)})" for m, f in _NAMED) + f") SELECT framework, count(*) AS n FROM part JOIN c ON p_partkey % {len(_MANIFESTS)} = m GROUP BY framework")
def _(t):
    """How many manifests name each framework: every part is one manifest."""
    path = F.concat(F.lit("m/"), F.col("p_partkey").cast("string"), F.lit("/"), pick([m for m, _ in _MANIFESTS]))
    found = detect.frameworks_by_manifest(t("part").select(path.alias("path"), pick([x for _, x in _MANIFESTS]).alias("text")))
    return found.groupBy("framework").agg(F.count("*").alias("n"))
