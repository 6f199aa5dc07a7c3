"""What a project is made of: stacks, components, ports, hosts, key files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.paths import base_name, extension, in_any_dir
from ..functions.severity import port_service, port_severity
from ..functions.text import any_of, choose, contains_any, first_where, lines_of, trimmed
from .file_checks import numbered_lines
from .roots import json_names

# ---- components and threats ----------------------------------------------

# Words in a compose file to component name and type.
COMPOSE_WORDS = (
    (("postgres",), "PostgreSQL", "db"),
    (("mysql", "mariadb"), "MySQL", "db"),
    (("redis",), "Redis", "cache"),
    (("nginx",), "Nginx", "proxy"),
    (("minio", "s3"), "MinIO/S3", "storage"),
    (("mongo",), "MongoDB", "db"),
    (("elasticsearch",), "Elasticsearch", "db"),
    (("rabbitmq",), "RabbitMQ", "message_broker"),
    (("kafka",), "Kafka", "message_broker"),
)
COMPOSE_FILES = ("docker-compose.yml", "docker-compose.yaml")
APP_FILES = (("go.mod", "Go App"), ("package.json", "Node.js App"), ("requirements.txt", "Python App"))


def detect_components(files: DataFrame, projects: DataFrame) -> DataFrame:
    """Application and infrastructure components per project, from root files."""
    path, low = F.col("path"), F.lower("content")
    at_root = files.filter(path.isin(*[n for n, _ in APP_FILES], *COMPOSE_FILES))
    in_compose = path.isin(*COMPOSE_FILES)
    flags = [F.max(path == n).alias(f"a{i}") for i, (n, _) in enumerate(APP_FILES)]
    flags += [
        F.max(in_compose & contains_any(low, words)).alias(f"c{i}") for i, (words, _, _) in enumerate(COMPOSE_WORDS)
    ]
    per = projects.select("project").distinct().join(at_root.groupBy("project").agg(*flags), "project", "left")
    per = per.fillna(False)

    def part(name: Column | str, kind: str) -> Column:
        return F.struct((F.lit(name) if isinstance(name, str) else name).alias("name"), F.lit(kind).alias("type"))

    app = first_where([(F.col(f"a{i}"), label) for i, (_, label) in enumerate(APP_FILES)], "Application")
    parts = [part(app, "app")]
    parts += [F.when(F.col(f"c{i}"), part(name, kind)) for i, (_, name, kind) in enumerate(COMPOSE_WORDS)]
    return per.select("project", F.explode(F.array_compact(F.array(*parts))).alias("c")).select(
        "project", F.col("c.name").alias("component"), F.col("c.type").alias("type")
    )


# Threat, severity, mitigation and points by component.
VECTORS = (
    ("PostgreSQL", "SQL/NoSQL Injection", "HIGH", "Use parameterized queries/ORMs exclusively.", 20),
    ("PostgreSQL", "Unauthenticated Access", "HIGH",
     "Ensure DB binds to localhost/internal network and requires strong passwords.", 0),
    ("MySQL", "SQL/NoSQL Injection", "HIGH", "Use parameterized queries/ORMs exclusively.", 20),
    ("MySQL", "Unauthenticated Access", "HIGH",
     "Ensure DB binds to localhost/internal network and requires strong passwords.", 0),
    ("MongoDB", "SQL/NoSQL Injection", "HIGH", "Use parameterized queries/ORMs exclusively.", 20),
    ("MongoDB", "Unauthenticated Access", "HIGH",
     "Ensure DB binds to localhost/internal network and requires strong passwords.", 0),
    ("Redis", "Unauthenticated Cache Access", "MEDIUM", "Enable Redis AUTH and bind to internal IP only.", 10),
    ("Nginx", "Misconfigured Security Headers", "MEDIUM",
     "Add HSTS, CSP, X-Frame-Options, and X-Content-Type-Options headers.", 0),
    ("MinIO", "Public Bucket Exposure", "HIGH",
     "Disable public access policies, use presigned URLs for client access.", 15),
    ("S3", "Public Bucket Exposure", "HIGH",
     "Disable public access policies, use presigned URLs for client access.", 15),
)
BROKER_VECTOR = ("Message Interception", "MEDIUM",
                 "Enable TLS for broker connections and authenticate publishers/subscribers.", 10)
NO_PROXY_VECTOR = ("Application", "Direct Database Exposure", "MEDIUM",
                   "Implement an API Gateway or Reverse Proxy to filter incoming traffic.", 10)
MAX_RISK = 100


def threat_vectors(components: DataFrame) -> DataFrame:
    """Attack vectors of each component, plus the missing-proxy rule per project."""
    cols = ["target", "threat_type", "severity", "mitigation", "points"]
    table = components.sparkSession.createDataFrame(
        list(VECTORS), "target string, threat_type string, severity string, mitigation string, points int"
    )
    by_name = components.withColumn("target", F.col("component")).join(F.broadcast(table), "target").select(
        "project", *cols
    )
    broker = components.filter(F.col("type") == "message_broker").select(
        "project", F.col("component").alias("target"),
        *[F.lit(v).alias(c) for c, v in zip(cols[1:], BROKER_VECTOR)],
    )
    shape = components.groupBy("project").agg(
        F.max(F.col("type") == "db").alias("_db"), F.max(F.col("type") == "proxy").alias("_proxy")
    )
    exposed = shape.filter(F.col("_db") & ~F.col("_proxy")).select(
        "project", *[F.lit(v).alias(c) for c, v in zip(cols, NO_PROXY_VECTOR)]
    )
    return by_name.unionByName(broker).unionByName(exposed)


def threat_surface(components: DataFrame) -> DataFrame:
    """Vectors and capped risk score per project."""
    per = threat_vectors(components).groupBy("project").agg(
        F.count(F.lit(1)).alias("vectors"),
        F.count_if(F.col("severity") == "HIGH").alias("high_vectors"),
        F.least(F.sum("points"), F.lit(MAX_RISK)).cast("long").alias("risk_score"),
    )
    return components.select("project").distinct().join(per, "project", "left").fillna(0)


# What to do about files that a project lacks.
UNPACKED_ENV = (
    "Environment variables loaded from .env without containerization. Ensure .env is explicitly excluded from version control."
)
OPEN_COMPOSE = (
    "Docker Compose deployment lacks a reverse proxy. Consider adding Nginx/Traefik for TLS termination and routing."
)


def threat_recommendations(files: DataFrame, components: DataFrame) -> DataFrame:
    """(project, recommendation): settings without containers, compose files without a proxy.

    Only names of root files are looked at; partial flags per project are shuffled."""
    path = F.col("path")
    has = files.filter(path.isin(".env", "Dockerfile", *COMPOSE_FILES)).groupBy("project").agg(
        F.max(path == ".env").alias("_env"), F.max(path == "Dockerfile").alias("_docker"),
        F.max(path.isin(*COMPOSE_FILES)).alias("_compose"),
    )
    proxies = components.filter(F.col("type") == "proxy").select("project", F.lit(True).alias("_proxy")).distinct()
    proxy = F.coalesce("_proxy", F.lit(False))
    advice = F.array_compact(
        F.array(
            F.when(F.col("_env") & ~F.col("_docker") & ~F.col("_compose"), F.lit(UNPACKED_ENV)),
            F.when(F.col("_compose") & ~proxy, F.lit(OPEN_COMPOSE)),
        )
    )
    return has.join(proxies, "project", "left").select("project", F.explode(advice).alias("recommendation"))


# ---- deployment files -----------------------------------------------------

# Advice by issue.
DEPLOY_ADVICE = {
    "dockerfile_root_user": "Add USER nonroot or create a dedicated user. Running as root in containers is a security risk.",
    "dockerfile_add_instead_of_copy": "Prefer COPY over ADD unless you need URL fetching or tar extraction.",
    "dockerfile_hardcoded_secret": "Never hardcode secrets in Dockerfile ENV. Use --secret or runtime env injection.",
    "compose_hardcoded_secret": "Use environment variable substitution: ${MY_PASSWORD}",
    "compose_privileged_mode": "Remove privileged: true. Grant only specific capabilities with cap_add instead.",
    "nginx_runs_as_root":
        "Nginx configured to run as root. Change user directive to a non-privileged user like 'nginx' or 'www-data'.",
    "nginx_server_tokens_on": "server_tokens on exposes Nginx version. Set to off to reduce information disclosure.",
    "nginx_missing_server_tokens_off": "Missing 'server_tokens off;' directive. It's recommended to hide Nginx version.",
    "nginx_missing_xframe_options":
        "Missing 'add_header X-Frame-Options SAMEORIGIN;'. This leaves the app vulnerable to Clickjacking.",
    "nginx_missing_csp": "Missing Content-Security-Policy header. Consider adding one to prevent XSS.",
    "makefile_hardcoded_secret":
        "Potential hardcoded secret found in Makefile variable assignment. Extract to .env or inject via CI/CD.",
    "k8s_privileged_container":
        "Container is running in privileged mode. This allows root access to the host node. "
        "Use explicit securityContext capabilities instead.",
    "k8s_run_as_root":
        "SecurityContext forces container to run as root. Prefer running as non-root user for defense-in-depth.",
}


def deploy_kind(path: Column, content: Column) -> Column:
    """docker, compose, k8s, nginx or make; null for other files."""
    name = F.lower(base_name(path))
    k8s = F.rlike(content, F.lit(r"(?m)^(?:apiVersion|kind)[ \t]*:"))
    kind = first_where(
        [
            ((name == "dockerfile") | F.endswith(name, F.lit(".dockerfile")), "docker"),
            (name.isin(*COMPOSE_FILES), "compose"),
            (F.endswith(name, F.lit(".yaml")) | F.endswith(name, F.lit(".yml")), F.when(k8s, F.lit("k8s"))),
            (F.endswith(name, F.lit(".conf")), "nginx"),
            (name.isin("makefile", "gnumakefile"), "make"),
        ]
    )
    return F.when(~in_any_dir(path, (".git", "node_modules", "vendor")), kind)


def deploy_hits(file_kind: Column, content: Column) -> Column:
    """Array of (line, f: (issue, severity, evidence), text) of a file of that kind."""

    def finding(issue: str, severity: str, evidence: Column) -> Column:
        return F.struct(F.lit(issue).alias("issue"), F.lit(severity).alias("severity"), evidence.alias("evidence"))

    def checks(raw: Column) -> Column:
        t, kind = trimmed(raw), file_kind
        low = F.lower(t)
        key = F.trim(F.regexp_extract(raw, r"""^\s*(?:-\s+)?["']?([\w.-]+)["']?\s*:""", 1))
        value = F.regexp_extract(raw, r"""^\s*(?:-\s+)?["']?[\w.-]+["']?\s*:[ \t]+["']?([^"'#\n]*?)["']?\s*(?:#.*)?\z""", 1)
        is_true = F.lower(value) == "true"

        def starts(word: str, col: Column = t) -> Column:
            return F.startswith(col, F.lit(word))

        def has(col: Column, *words: str) -> Column:
            return contains_any(col, words)

        rows = [
            F.when(
                (kind == "docker") & (starts("USER root") | (starts("USER") & ~has(t, "USER "))),
                finding("dockerfile_root_user", "HIGH", t),
            ),
            F.when(
                (kind == "docker") & starts("ADD ") & ~has(t, ".tar"), finding("dockerfile_add_instead_of_copy", "LOW", t)
            ),
            F.when(
                (kind == "docker") & starts("ENV ") & has(t, "PASSWORD", "SECRET", "API_KEY"),
                finding("dockerfile_hardcoded_secret", "CRITICAL", F.concat(F.left(t, F.lit(50)), F.lit("..."))),
            ),
            F.when(
                (kind == "nginx") & (starts("user root;", low) | starts("user root ", low)),
                finding("nginx_runs_as_root", "CRITICAL", t),
            ),
            F.when((kind == "nginx") & has(low, "server_tokens on;"), finding("nginx_server_tokens_on", "LOW", t)),
            F.when(
                (kind == "make") & has(low, "password", "secret", "api_key", "token") & has(t, "=")
                & ~has(t, "$(", "${"),
                finding("makefile_hardcoded_secret", "HIGH", F.left(t, F.lit(60))),
            ),
            F.when(
                (kind == "compose") & has(F.lower(key), "password", "secret") & (value != "") & ~has(value, "${"),
                finding("compose_hardcoded_secret", "CRITICAL", F.concat(key, F.lit(": "), F.left(value, F.lit(20)))),
            ),
            F.when(
                (kind == "compose") & (F.lower(key) == "privileged") & is_true,
                finding("compose_privileged_mode", "HIGH", F.lit("privileged: true")),
            ),
            F.when(
                (kind == "k8s") & (key == "privileged") & is_true,
                finding("k8s_privileged_container", "CRITICAL", F.lit("privileged: true")),
            ),
            F.when(
                (kind == "k8s") & (key == "runAsUser") & (value == "0"),
                finding("k8s_run_as_root", "HIGH", F.lit("runAsUser: 0")),
            ),
        ]
        return F.array_compact(F.array(*rows))

    per_line = F.flatten(
        F.transform(
            lines_of(content),
            lambda s, i: F.transform(
                checks(s), lambda f: F.struct((i + 1).alias("line"), f.alias("f"), trimmed(s).alias("text"))
            ),
        )
    )
    low = F.lower(content)
    absent = [
        ("server_tokens off;", "nginx_missing_server_tokens_off", "LOW"),
        ("x-frame-options", "nginx_missing_xframe_options", "MEDIUM"),
        ("content-security-policy", "nginx_missing_csp", "LOW"),
    ]
    whole = F.array_compact(
        F.array(
            *[
                F.when(
                    (file_kind == "nginx") & ~F.contains(low, F.lit(word)),
                    F.struct(
                        F.lit(1).alias("line"), finding(issue, sev, F.lit("Whole file")).alias("f"), F.lit("").alias("text")
                    ),
                )
                for word, issue, sev in absent
            ]
        )
    )
    return F.concat(per_line, whole)


def deploy_audit(files: DataFrame) -> DataFrame:
    """Dockerfile, nginx, Makefile, Compose and Kubernetes checks, line by line.

    ``evidence`` is short for display, ``text`` the whole trimmed line (empty for a finding
    about a whole file). With ``path`` as file the rows are a feed of ``union_scanners`` and
    ``ingest_union`` (see ``deploy_feed``)."""
    path, content = F.col("path"), F.col("content")
    scope = files.withColumn("_kind", deploy_kind(path, content)).filter(F.col("_kind").isNotNull())
    hits = scope.select("project", "path", F.explode(deploy_hits(F.col("_kind"), content)).alias("h"))
    return hits.select(
        "project", "path", "h.line", "h.f.issue", "h.f.severity", "h.f.evidence",
        choose(F.col("h.f.issue"), DEPLOY_ADVICE).alias("advice"), "h.text",
    )


def deploy_feed(files: DataFrame) -> DataFrame:
    """``deploy_audit`` as a scanner feed: project, file, line, issue, severity, advice."""
    return deploy_audit(files).select("project", F.col("path").alias("file"), "line", "issue", "severity", "advice")


# ---- network --------------------------------------------------------------

HOST_EXTS = (".yaml", ".yml", ".env", ".conf", ".json", ".go")


def extract_hosts(files: DataFrame) -> DataFrame:
    """Host-like words of configuration and Go files, plus localhost, per project."""
    path = F.col("path")
    scope = files.filter(extension(path).isin(*HOST_EXTS) & ~in_any_dir(path, (".git", "node_modules")))
    lines = numbered_lines(scope, ["project"], lambda t: contains_any(t, ("http", "host", "addr", "127.0.0.1")))
    words = F.transform(F.split("text", r"[\"'=:/ ]"), trimmed)
    noted = contains_any(F.col("text"), ("http", "host", "addr"))
    good = F.filter(
        words,
        lambda w: (F.octet_length(w) > 2)
        & ((F.contains(w, F.lit(".")) & ~F.startswith(w, F.lit("0."))) | (w == "localhost")),
    )
    found = lines.filter(noted).select("project", F.explode(F.array_distinct(good)).alias("host"))
    local = files.select("project").distinct().withColumn("host", F.lit("127.0.0.1"))
    return found.unionByName(local).distinct()


PORT_LINE = r"""^\s*-\s*["']?((?:[\d.]+:)?(?:\d+:)?\d+(?:/\w+)?)["']?\s*\z"""


def compose_ports(files: DataFrame) -> DataFrame:
    """Host port of every Compose port mapping, classified; nothing is contacted."""
    names = (*COMPOSE_FILES, "compose.yml", "compose.yaml")
    scope = files.filter(base_name(F.col("path")).isin(*names))
    lines = numbered_lines(scope, ["project", "path"], lambda t: F.rlike(t, F.lit(PORT_LINE)))
    parts = F.split(F.regexp_extract("text", PORT_LINE, 1), ":")
    host = F.when(F.size(parts) <= 2, F.element_at(parts, 1)).otherwise(F.try_element_at(parts, F.lit(-2)))
    port = F.substring_index(host, "/", 1).try_cast("int")
    return (
        lines.select("project", "path", "line", port.alias("port"))
        .filter(F.col("port") > 0)
        .withColumns({"service": port_service(F.col("port")), "severity": port_severity(F.col("port"))})
    )


# ---- key files and markers ------------------------------------------------

# File names by role.
MANIFEST_NAMES = (
    "package.json", "requirements.txt", "go.mod", "Cargo.toml", "Gemfile", "composer.json", "pyproject.toml",
    "Pipfile", "pom.xml", "build.gradle",
)
CONFIG_NAMES = (
    "Dockerfile", "docker-compose.yml", "docker-compose.yaml", ".env.example", "tsconfig.json", "vite.config.ts",
    "vite.config.js", "webpack.config.js", "next.config.js", "next.config.ts", "nginx.conf",
)
ENTRY_NAMES = (
    "main.go", "main.py", "app.py", "asgi.py", "wsgi.py", "manage.py", "index.ts", "index.js", "server.ts",
    "server.js", "app.ts", "app.js", "main.ts", "main.js",
)
SECURITY_WORDS = (
    "auth", "login", "session", "middleware", "permission", "security", "guard", "policy", "rbac", "acl",
    "route", "router", "handler", "controller", "endpoint",
)
KEY_CODE_EXTS = (".go", ".py", ".js", ".ts", ".jsx", ".tsx", ".rb", ".java", ".rs", ".php", ".cs")
KEY_SKIP_DIRS = (
    ".git", "node_modules", "venv", ".venv", "__pycache__", ".next", "dist", "build", ".nuxt", "vendor", ".idea",
    ".vscode", ".terraform", "target", "coverage",
)
KEY_FILE_CHARS, SECURITY_FILES = 8192, 10
# Entry points up to three folders down, security-named code up to four.
ENTRY_SHAPE = r"^(?:[^/]+/){0,3}(?:" + "|".join(re.escape(n) for n in ENTRY_NAMES) + r")\z"
SECURITY_SHAPE = (
    r"^(?:[^/]+/){0,4}(?=[^/]*(?:" + "|".join(re.escape(e) for e in KEY_CODE_EXTS) + r")\z)"
    r"[^/]*(?:" + "|".join(SECURITY_WORDS) + r")[^/]*\z"
)


def key_files(files: DataFrame, chars: int = KEY_FILE_CHARS, security: int = SECURITY_FILES) -> DataFrame:
    """Manifests, configuration, entry points and security-named code: an excerpt of
    ``chars`` characters, ``security`` files of the last kind."""
    path = F.col("path")
    role = first_where(
        [
            (path.isin(*MANIFEST_NAMES), "manifest"),
            (path.isin(*CONFIG_NAMES), "config"),
            (F.rlike(path, F.lit(ENTRY_SHAPE)), "entrypoint"),
            (F.rlike(F.lower(path), F.lit(SECURITY_SHAPE)), "security"),
        ]
    )
    found = files.filter(~in_any_dir(path, KEY_SKIP_DIRS) & (F.col("content") != "")).withColumn("role", role)
    found = found.filter(F.col("role").isNotNull())
    # The cap is the feature: the first few security-named files of a project.
    # A rank limit this small is also applied before the shuffle.
    first = Window.partitionBy("project", "role").orderBy("path")
    capped = (
        found.filter(F.col("role") == "security").select("project", "role", "path")
        .withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= security)
        .select("project", "path")
    )
    cut = F.when(
        F.length("content") > chars,
        F.concat(F.left("content", F.lit(chars)), F.lit("\n... (truncated)")),
    ).otherwise(F.col("content"))
    shaped = found.withColumn("excerpt", cut).select("project", "path", "role", "excerpt")
    chosen = shaped.filter(F.col("role") == "security").join(capped, ["project", "path"], "left_semi")
    return shaped.filter(F.col("role") != "security").unionByName(chosen)


# Paths and dependency names that tell what kind of project it is.
MARKER_PATHS = (
    "package.json", "vite.config.ts", "vite.config.js", "src/main.tsx", "src/main.jsx", "src/App.tsx",
    "src/App.jsx", "server.ts", "server.js", "src/server.ts", "src/server.js", "pages/api", "app/api", "go.mod",
    "requirements.txt",
)
FRONTEND_DEPS = ("react", "react-dom", "vite", "@vitejs/plugin-react", "tailwindcss")
BACKEND_DEPS = ("express", "fastify", "koa", "hono", "next", "@remix-run/node", "@nestjs/core")


def project_markers(files: DataFrame) -> DataFrame:
    """Marker paths present per project, and known dependency names in package.json."""
    path = F.col("path")
    is_dir = F.filter(
        F.array(*[F.lit(m) for m in MARKER_PATHS if m.endswith("/api")]),
        lambda m: F.startswith(path, F.concat(m, F.lit("/"))),
    )
    own = F.when(path.isin(*MARKER_PATHS), F.array(path)).otherwise(F.array().cast("array<string>"))

    def rows(kind: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("marker")))

    names = F.when(path == "package.json", json_names(F.col("content"), "dependencies", "devDependencies")).otherwise(
        F.array().cast("array<string>")
    )
    found = F.concat(
        rows("path", F.concat(own, is_dir)),
        rows("frontend", F.array_intersect(names, F.array(*[F.lit(d) for d in FRONTEND_DEPS]))),
        rows("backend", F.array_intersect(names, F.array(*[F.lit(d) for d in BACKEND_DEPS]))),
    )
    near = files.filter(path.isin(*MARKER_PATHS) | any_of([F.startswith(path, F.lit(f"{m}/")) for m in MARKER_PATHS]))
    return near.select("project", F.explode(found).alias("m")).select("project", "m.kind", "m.marker").distinct()
