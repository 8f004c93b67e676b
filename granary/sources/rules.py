"""Technology rules, categories and ecosystems as dimension tables.

Rules are YAML files in folders named after their type, read on the driver (they
are configuration) and turned into tables that joins broadcast.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def read_rules(folder: str) -> list[dict]:
    """The rules of a folder tree, in order of path; the type is the folder's name where a rule names none."""
    import yaml

    out = []
    for here, _, names in sorted(os.walk(folder)):
        for name in sorted(names):
            if name.endswith((".yaml", ".yml")) and name != "_types.yaml":
                with open(os.path.join(here, name), encoding="utf-8") as f:
                    found = yaml.safe_load(f)
                for rule in found if isinstance(found, list) else [found]:
                    if isinstance(rule, dict):
                        out.append({"type": os.path.basename(here), **rule})
    return out


def check(rules: Sequence[dict]) -> list[str]:
    """What is wrong with rules: missing technology, name or type, dependencies without type or name."""
    out = []
    for k, r in enumerate(rules):
        out += [f"rule {k}: no {key}" for key in ("tech", "name", "type") if not r.get(key)]
        out += [f"rule {k} ({r.get('tech')}): dependency {i} without type or name" for i, d in enumerate(r.get("dependencies") or []) if not (d.get("type") and d.get("name"))]
    return out


#: Rules to start with; a scan takes a folder of its own in their place.
STARTER = [
    {"tech": "react", "name": "React", "type": "framework", "dependencies": [{"type": "npm", "name": "react"}]},
    {"tech": "vue", "name": "Vue", "type": "framework", "dependencies": [{"type": "npm", "name": "vue"}]},
    {"tech": "express", "name": "Express", "type": "framework", "dependencies": [{"type": "npm", "name": "express"}]},
    {"tech": "django", "name": "Django", "type": "framework", "dependencies": [{"type": "pypi", "name": "django"}]},
    {"tech": "flask", "name": "Flask", "type": "framework", "dependencies": [{"type": "pypi", "name": "flask"}]},
    {"tech": "spring", "name": "Spring", "type": "framework", "dependencies": [{"type": "maven", "name": "/^org\\.springframework(\\..*)?:.*/"}]},
    {"tech": "postgresql", "name": "PostgreSQL", "type": "database", "is_component": True, "dependencies": [{"type": "npm", "name": "pg"}, {"type": "pypi", "name": "/^psycopg.*/"}, {"type": "docker", "name": "/^(.*\\/)?postgres$/"}], "dotenv": ["POSTGRES"]},
    {"tech": "redis", "name": "Redis", "type": "database", "is_component": True, "dependencies": [{"type": "npm", "name": "redis"}, {"type": "pypi", "name": "redis"}, {"type": "docker", "name": "redis"}], "dotenv": ["REDIS"]},
    {"tech": "aws", "name": "AWS", "type": "cloud", "dependencies": [{"type": "npm", "name": "/^@aws-sdk\\/.*/"}, {"type": "pypi", "name": "boto3"}, {"type": "terraform", "name": "/hashicorp\\/aws$/"}], "dotenv": ["AWS_"]},
    {"tech": "docker", "name": "Docker", "type": "tool", "files": ["Dockerfile", "docker-compose.yml"]},
    {"tech": "githubactions", "name": "GitHub Actions", "type": "ci", "files": [".github/workflows"]},
    {"tech": "typescript", "name": "TypeScript", "type": "language", "files": ["tsconfig.json"], "dependencies": [{"type": "npm", "name": "typescript"}], "extensions": [".ts"]},
    {"tech": "python", "name": "Python", "type": "language", "files": ["pyproject.toml", "requirements.txt"], "extensions": [".py"]},
    {"tech": "golang", "name": "Go", "type": "language", "files": ["go.mod"], "extensions": [".go"]},
    {"tech": "pytest", "name": "pytest", "type": "test", "dependencies": [{"type": "pypi", "name": "pytest"}], "content": [{"type": "regex", "pattern": "\\bimport pytest\\b", "extensions": [".py"]}]},
]
def _rule(tech: str, name: str, kind: str, files: Sequence[str] = (), variables: Sequence[str] = (), **packages: str) -> dict:
    """A rule from package names by dependency type, several names apart by blanks."""
    out: dict = {"tech": tech, "name": name, "type": kind}
    if packages:
        out["dependencies"] = [{"type": t, "name": n} for t, names in packages.items() for n in names.split()]
    return out | ({"files": list(files)} if files else {}) | ({"dotenv": list(variables)} if variables else {})


# More rules, over the names that packages have in their public registries.
STARTER += [
    # Web frameworks and libraries of user interfaces
    _rule("angular", "Angular", "framework", files=["angular.json"], npm="@angular/core"),
    _rule("svelte", "Svelte", "framework", files=["svelte.config.js"], npm="svelte"),
    _rule("nextjs", "Next.js", "framework", files=["next.config.js", "next.config.mjs", "next.config.ts"], npm="next"),
    _rule("nuxt", "Nuxt", "framework", files=["nuxt.config.ts", "nuxt.config.js"], npm="nuxt"),
    _rule("gatsby", "Gatsby", "framework", files=["gatsby-config.js"], npm="gatsby"),
    _rule("astro", "Astro", "framework", files=["astro.config.mjs"], npm="astro"),
    _rule("remix", "Remix", "framework", npm="@remix-run/react @remix-run/node"),
    _rule("solidjs", "SolidJS", "framework", npm="solid-js"),
    _rule("preact", "Preact", "framework", npm="preact"),
    _rule("ember", "Ember", "framework", npm="ember-source"),
    _rule("reactnative", "React Native", "framework", npm="react-native"),
    _rule("electron", "Electron", "framework", npm="electron"),
    _rule("nestjs", "NestJS", "framework", files=["nest-cli.json"], npm="@nestjs/core"),
    _rule("koa", "Koa", "framework", npm="koa"),
    _rule("fastify", "Fastify", "framework", npm="fastify"),
    _rule("hapi", "hapi", "framework", npm="@hapi/hapi"),
    _rule("fastapi", "FastAPI", "framework", pypi="fastapi"),
    _rule("starlette", "Starlette", "framework", pypi="starlette"),
    _rule("tornado", "Tornado", "framework", pypi="tornado"),
    _rule("aiohttp", "aiohttp", "framework", pypi="aiohttp"),
    _rule("streamlit", "Streamlit", "framework", pypi="streamlit"),
    _rule("quarkus", "Quarkus", "framework", maven="io.quarkus:quarkus-core"),
    _rule("micronaut", "Micronaut", "framework", maven="io.micronaut:micronaut-core"),
    _rule("vertx", "Vert.x", "framework", maven="io.vertx:vertx-core"),
    _rule("gin", "Gin", "framework", golang="github.com/gin-gonic/gin"),
    _rule("echo", "Echo", "framework", golang="github.com/labstack/echo/v4"),
    _rule("fiber", "Fiber", "framework", golang="github.com/gofiber/fiber/v2"),
    _rule("chi", "chi", "framework", golang="github.com/go-chi/chi/v5"),
    _rule("actix", "Actix Web", "framework", cargo="actix-web"),
    _rule("axum", "axum", "framework", cargo="axum"),
    _rule("rocket", "Rocket", "framework", cargo="rocket"),
    _rule("tauri", "Tauri", "framework", files=["tauri.conf.json"], npm="@tauri-apps/api", cargo="tauri"),
    _rule("rails", "Ruby on Rails", "framework", gem="rails"),
    _rule("sinatra", "Sinatra", "framework", gem="sinatra"),
    _rule("laravel", "Laravel", "framework", files=["artisan"], composer="laravel/framework"),
    _rule("symfony", "Symfony", "framework", files=["symfony.lock"], composer="symfony/framework-bundle symfony/symfony"),
    _rule("phoenix", "Phoenix", "framework", hex="phoenix"),
    _rule("aspnetcore", "ASP.NET Core", "framework", nuget="Microsoft.AspNetCore.App Microsoft.AspNetCore.OpenApi"),
    _rule("blazor", "Blazor", "framework", nuget="Microsoft.AspNetCore.Components.WebAssembly"),
    _rule("flutter", "Flutter", "framework", pub="flutter"),
    # Interfaces, state and styles
    _rule("tailwind", "Tailwind CSS", "library", files=["tailwind.config.js", "tailwind.config.ts"], npm="tailwindcss"),
    _rule("bootstrap", "Bootstrap", "library", npm="bootstrap"),
    _rule("mui", "MUI", "library", npm="@mui/material"),
    _rule("redux", "Redux", "library", npm="redux @reduxjs/toolkit"),
    _rule("zustand", "Zustand", "library", npm="zustand"),
    _rule("rxjs", "RxJS", "library", npm="rxjs"),
    _rule("jquery", "jQuery", "library", npm="jquery"),
    _rule("d3", "D3", "library", npm="d3"),
    _rule("threejs", "three.js", "library", npm="three"),
    _rule("lodash", "Lodash", "library", npm="lodash"),
    _rule("zod", "Zod", "library", npm="zod"),
    _rule("graphql", "GraphQL", "library", npm="graphql", pypi="graphene strawberry-graphql", golang="github.com/99designs/gqlgen"),
    _rule("apollo", "Apollo", "library", npm="@apollo/client @apollo/server"),
    _rule("grpc", "gRPC", "library", npm="@grpc/grpc-js", pypi="grpcio", golang="google.golang.org/grpc", cargo="tonic", maven="io.grpc:grpc-netty io.grpc:grpc-stub"),
    _rule("protobuf", "Protocol Buffers", "library", files=["buf.yaml"], npm="protobufjs", pypi="protobuf", golang="google.golang.org/protobuf", maven="com.google.protobuf:protobuf-java"),
    _rule("pydantic", "Pydantic", "library", pypi="pydantic"),
    _rule("requests", "Requests", "library", pypi="requests"),
    _rule("lombok", "Lombok", "library", maven="org.projectlombok:lombok"),
    _rule("jackson", "Jackson", "library", maven="com.fasterxml.jackson.core:jackson-databind"),
    _rule("guava", "Guava", "library", maven="com.google.guava:guava"),
    _rule("tokio", "Tokio", "library", cargo="tokio"),
    _rule("serde", "Serde", "library", cargo="serde"),
    _rule("cobra", "Cobra", "library", golang="github.com/spf13/cobra"),
    # Data, numbers and learning
    _rule("numpy", "NumPy", "data", pypi="numpy"),
    _rule("pandas", "pandas", "data", pypi="pandas"),
    _rule("polars", "Polars", "data", pypi="polars", cargo="polars"),
    _rule("spark", "Apache Spark", "data", pypi="pyspark", maven="org.apache.spark:spark-core_2.12 org.apache.spark:spark-core_2.13 org.apache.spark:spark-sql_2.12 org.apache.spark:spark-sql_2.13"),
    _rule("flink", "Apache Flink", "data", pypi="apache-flink", maven="org.apache.flink:flink-streaming-java"),
    _rule("airflow", "Apache Airflow", "data", pypi="apache-airflow"),
    _rule("dbt", "dbt", "data", files=["dbt_project.yml"], pypi="dbt-core"),
    _rule("duckdb", "DuckDB", "data", npm="duckdb", pypi="duckdb", cargo="duckdb"),
    _rule("pytorch", "PyTorch", "ai", pypi="torch"),
    _rule("tensorflow", "TensorFlow", "ai", pypi="tensorflow", npm="@tensorflow/tfjs"),
    _rule("scikitlearn", "scikit-learn", "ai", pypi="scikit-learn"),
    _rule("xgboost", "XGBoost", "ai", pypi="xgboost"),
    _rule("transformers", "Transformers", "ai", pypi="transformers"),
    _rule("langchain", "LangChain", "ai", pypi="langchain langchain-core", npm="langchain @langchain/core"),
    _rule("openai", "OpenAI", "ai", variables=["OPENAI_API"], npm="openai", pypi="openai"),
    _rule("onnx", "ONNX", "ai", pypi="onnx onnxruntime", npm="onnxruntime-node"),
    # Databases, caches and search
    _rule("mysql", "MySQL", "database", variables=["MYSQL_"], npm="mysql mysql2", pypi="pymysql mysqlclient mysql-connector-python", golang="github.com/go-sql-driver/mysql", gem="mysql2", maven="com.mysql:mysql-connector-j mysql:mysql-connector-java", nuget="MySqlConnector MySql.Data", docker="mysql"),
    _rule("mariadb", "MariaDB", "database", variables=["MARIADB_"], npm="mariadb", pypi="mariadb", maven="org.mariadb.jdbc:mariadb-java-client", docker="mariadb"),
    _rule("sqlite", "SQLite", "database", npm="sqlite3 better-sqlite3", golang="github.com/mattn/go-sqlite3 modernc.org/sqlite", gem="sqlite3", cargo="rusqlite", maven="org.xerial:sqlite-jdbc", nuget="Microsoft.Data.Sqlite"),
    _rule("mongodb", "MongoDB", "database", variables=["MONGO"], npm="mongodb mongoose", pypi="pymongo motor", golang="go.mongodb.org/mongo-driver", gem="mongoid", cargo="mongodb", maven="org.mongodb:mongodb-driver-sync", nuget="MongoDB.Driver", docker="mongo"),
    _rule("sqlserver", "SQL Server", "database", npm="mssql", pypi="pymssql", golang="github.com/microsoft/go-mssqldb", maven="com.microsoft.sqlserver:mssql-jdbc", nuget="Microsoft.Data.SqlClient", docker="mcr.microsoft.com/mssql/server"),
    _rule("oracledb", "Oracle Database", "database", npm="oracledb", pypi="oracledb cx_Oracle", maven="com.oracle.database.jdbc:ojdbc11", nuget="Oracle.ManagedDataAccess.Core"),
    _rule("cassandra", "Apache Cassandra", "database", npm="cassandra-driver", pypi="cassandra-driver", docker="cassandra"),
    _rule("neo4j", "Neo4j", "database", variables=["NEO4J_"], npm="neo4j-driver", pypi="neo4j", maven="org.neo4j.driver:neo4j-java-driver", docker="neo4j"),
    _rule("elasticsearch", "Elasticsearch", "database", variables=["ELASTICSEARCH_"], npm="@elastic/elasticsearch", pypi="elasticsearch", golang="github.com/elastic/go-elasticsearch/v8", docker="elasticsearch docker.elastic.co/elasticsearch/elasticsearch"),
    _rule("opensearch", "OpenSearch", "database", npm="@opensearch-project/opensearch", pypi="opensearch-py", docker="opensearchproject/opensearch"),
    _rule("clickhouse", "ClickHouse", "database", npm="@clickhouse/client", pypi="clickhouse-connect clickhouse-driver", golang="github.com/ClickHouse/clickhouse-go/v2", docker="clickhouse/clickhouse-server"),
    _rule("influxdb", "InfluxDB", "database", npm="@influxdata/influxdb-client", pypi="influxdb-client", docker="influxdb"),
    _rule("memcached", "Memcached", "database", npm="memjs", pypi="pymemcache", docker="memcached"),
    _rule("qdrant", "Qdrant", "database", npm="@qdrant/js-client-rest", pypi="qdrant-client", docker="qdrant/qdrant"),
    # Mapping of objects to tables, and migrations
    _rule("sqlalchemy", "SQLAlchemy", "orm", pypi="sqlalchemy SQLAlchemy"),
    _rule("alembic", "Alembic", "orm", files=["alembic.ini"], pypi="alembic"),
    _rule("prisma", "Prisma", "orm", files=["schema.prisma"], npm="prisma @prisma/client"),
    _rule("typeorm", "TypeORM", "orm", npm="typeorm"),
    _rule("sequelize", "Sequelize", "orm", npm="sequelize"),
    _rule("drizzle", "Drizzle", "orm", files=["drizzle.config.ts"], npm="drizzle-orm"),
    _rule("hibernate", "Hibernate", "orm", maven="org.hibernate.orm:hibernate-core org.hibernate:hibernate-core"),
    _rule("gorm", "GORM", "orm", golang="gorm.io/gorm"),
    _rule("diesel", "Diesel", "orm", files=["diesel.toml"], cargo="diesel"),
    _rule("efcore", "Entity Framework Core", "orm", nuget="Microsoft.EntityFrameworkCore"),
    _rule("doctrine", "Doctrine", "orm", composer="doctrine/orm"),
    # Messaging
    _rule("kafka", "Apache Kafka", "messaging", variables=["KAFKA_"], npm="kafkajs", pypi="kafka-python confluent-kafka aiokafka", golang="github.com/segmentio/kafka-go github.com/IBM/sarama", cargo="rdkafka", maven="org.apache.kafka:kafka-clients", nuget="Confluent.Kafka", docker="confluentinc/cp-kafka apache/kafka"),
    _rule("rabbitmq", "RabbitMQ", "messaging", variables=["RABBITMQ_"], npm="amqplib", pypi="pika", golang="github.com/rabbitmq/amqp091-go", gem="bunny", maven="com.rabbitmq:amqp-client", nuget="RabbitMQ.Client", docker="rabbitmq"),
    _rule("nats", "NATS", "messaging", npm="nats", pypi="nats-py", golang="github.com/nats-io/nats.go", docker="nats"),
    _rule("celery", "Celery", "messaging", variables=["CELERY_"], pypi="celery"),
    _rule("sidekiq", "Sidekiq", "messaging", gem="sidekiq"),
    _rule("bullmq", "BullMQ", "messaging", npm="bullmq bull"),
    _rule("socketio", "Socket.IO", "messaging", npm="socket.io socket.io-client", pypi="python-socketio"),
    # Clouds, hosting and services
    _rule("gcp", "Google Cloud", "cloud", variables=["GOOGLE_CLOUD_", "GCP_"], npm="/^@google-cloud\\/.*/", pypi="/^google-cloud-.*/", terraform="/hashicorp\\/google$/"),
    _rule("azure", "Microsoft Azure", "cloud", variables=["AZURE_"], npm="/^@azure\\/.*/", pypi="/^azure-.*/", nuget="/^Azure\\..*/", terraform="/hashicorp\\/azurerm$/"),
    _rule("cloudflare", "Cloudflare", "cloud", files=["wrangler.toml"], variables=["CLOUDFLARE_"], npm="wrangler", terraform="/cloudflare\\/cloudflare$/"),
    _rule("vercel", "Vercel", "hosting", files=["vercel.json"], npm="vercel"),
    _rule("netlify", "Netlify", "hosting", files=["netlify.toml"], npm="netlify-cli"),
    _rule("heroku", "Heroku", "hosting", files=["Procfile"]),
    _rule("flyio", "Fly.io", "hosting", files=["fly.toml"]),
    _rule("firebase", "Firebase", "cloud", files=["firebase.json"], variables=["FIREBASE_"], npm="firebase firebase-admin", pypi="firebase-admin"),
    _rule("supabase", "Supabase", "cloud", variables=["SUPABASE_"], npm="@supabase/supabase-js", pypi="supabase"),
    _rule("stripe", "Stripe", "service", variables=["STRIPE_"], npm="stripe @stripe/stripe-js", pypi="stripe", gem="stripe", golang="github.com/stripe/stripe-go/v76", composer="stripe/stripe-php", nuget="Stripe.net"),
    _rule("twilio", "Twilio", "service", variables=["TWILIO_"], npm="twilio", pypi="twilio", nuget="Twilio"),
    _rule("sendgrid", "SendGrid", "service", variables=["SENDGRID_"], npm="@sendgrid/mail", pypi="sendgrid", nuget="SendGrid"),
    _rule("auth0", "Auth0", "service", variables=["AUTH0_"], npm="auth0 @auth0/auth0-react", pypi="auth0-python"),
    _rule("keycloak", "Keycloak", "service", variables=["KEYCLOAK_"], npm="keycloak-js", docker="quay.io/keycloak/keycloak"),
    # Watching
    _rule("sentry", "Sentry", "monitoring", variables=["SENTRY_"], npm="@sentry/node @sentry/browser @sentry/react", pypi="sentry-sdk", golang="github.com/getsentry/sentry-go", gem="sentry-ruby", nuget="Sentry"),
    _rule("prometheus", "Prometheus", "monitoring", files=["prometheus.yml"], npm="prom-client", pypi="prometheus-client prometheus_client", golang="github.com/prometheus/client_golang", maven="io.micrometer:micrometer-registry-prometheus", docker="prom/prometheus"),
    _rule("grafana", "Grafana", "monitoring", docker="grafana/grafana"),
    _rule("opentelemetry", "OpenTelemetry", "monitoring", npm="@opentelemetry/api @opentelemetry/sdk-node", pypi="opentelemetry-api opentelemetry-sdk", golang="go.opentelemetry.io/otel", maven="io.opentelemetry:opentelemetry-api", nuget="OpenTelemetry"),
    _rule("datadog", "Datadog", "monitoring", variables=["DD_API_KEY"], npm="dd-trace", pypi="ddtrace datadog"),
    _rule("log4j", "Log4j", "monitoring", maven="org.apache.logging.log4j:log4j-core"),
    _rule("winston", "winston", "monitoring", npm="winston"),
    # Tests
    _rule("jest", "Jest", "test", files=["jest.config.js", "jest.config.ts"], npm="jest"),
    _rule("vitest", "Vitest", "test", files=["vitest.config.ts"], npm="vitest"),
    _rule("mocha", "Mocha", "test", files=[".mocharc.json", ".mocharc.yml"], npm="mocha"),
    _rule("cypress", "Cypress", "test", files=["cypress.config.js", "cypress.config.ts"], npm="cypress"),
    _rule("playwright", "Playwright", "test", files=["playwright.config.ts"], npm="@playwright/test playwright", pypi="playwright"),
    _rule("selenium", "Selenium", "test", npm="selenium-webdriver", pypi="selenium", maven="org.seleniumhq.selenium:selenium-java"),
    _rule("junit", "JUnit", "test", maven="junit:junit org.junit.jupiter:junit-jupiter org.junit.jupiter:junit-jupiter-api"),
    _rule("mockito", "Mockito", "test", maven="org.mockito:mockito-core"),
    _rule("testify", "Testify", "test", golang="github.com/stretchr/testify"),
    _rule("rspec", "RSpec", "test", files=[".rspec"], gem="rspec rspec-rails"),
    _rule("phpunit", "PHPUnit", "test", files=["phpunit.xml", "phpunit.xml.dist"], composer="phpunit/phpunit"),
    _rule("xunit", "xUnit.net", "test", nuget="xunit"),
    _rule("nunit", "NUnit", "test", nuget="NUnit"),
    _rule("hypothesis", "Hypothesis", "test", pypi="hypothesis"),
    # Builds, checks and delivery
    _rule("webpack", "webpack", "tool", files=["webpack.config.js"], npm="webpack"),
    _rule("vite", "Vite", "tool", files=["vite.config.js", "vite.config.ts"], npm="vite"),
    _rule("rollup", "Rollup", "tool", files=["rollup.config.js", "rollup.config.mjs"], npm="rollup"),
    _rule("esbuild", "esbuild", "tool", npm="esbuild"),
    _rule("babel", "Babel", "tool", files=["babel.config.js", ".babelrc"], npm="@babel/core"),
    _rule("eslint", "ESLint", "tool", files=["eslint.config.js", "eslint.config.mjs", ".eslintrc.json", ".eslintrc.js"], npm="eslint"),
    _rule("prettier", "Prettier", "tool", files=[".prettierrc", ".prettierrc.json"], npm="prettier"),
    _rule("ruff", "Ruff", "tool", files=["ruff.toml"], pypi="ruff"),
    _rule("mypy", "mypy", "tool", files=["mypy.ini"], pypi="mypy"),
    _rule("black", "Black", "tool", pypi="black"),
    _rule("cmake", "CMake", "tool", files=["CMakeLists.txt"]),
    _rule("make", "Make", "tool", files=["Makefile"]),
    _rule("bazel", "Bazel", "tool", files=["MODULE.bazel", "WORKSPACE.bazel"]),
    _rule("kubernetes", "Kubernetes", "tool", files=["kustomization.yaml"], pypi="kubernetes", golang="k8s.io/client-go"),
    _rule("helm", "Helm", "tool", files=["Chart.yaml"]),
    _rule("terraform", "Terraform", "tool", files=["*.tf", ".terraform.lock.hcl"]),
    _rule("ansible", "Ansible", "tool", files=["ansible.cfg"], pypi="ansible"),
    _rule("gitlabci", "GitLab CI", "ci", files=[".gitlab-ci.yml"]),
    _rule("jenkins", "Jenkins", "ci", files=["Jenkinsfile"]),
    _rule("circleci", "CircleCI", "ci", files=[".circleci/"]),
    _rule("travis", "Travis CI", "ci", files=[".travis.yml"]),
    _rule("dependabot", "Dependabot", "ci", files=["dependabot.yml"]),
    # Package managers
    _rule("npm", "npm", "package_manager", files=["package-lock.json"]),
    _rule("yarn", "Yarn", "package_manager", files=["yarn.lock"]),
    _rule("pnpm", "pnpm", "package_manager", files=["pnpm-lock.yaml"]),
    _rule("poetry", "Poetry", "package_manager", files=["poetry.lock"]),
    _rule("uv", "uv", "package_manager", files=["uv.lock"]),
    _rule("cargo", "Cargo", "package_manager", files=["Cargo.toml", "Cargo.lock"]),
    _rule("maven", "Maven", "package_manager", files=["pom.xml"]),
    _rule("gradle", "Gradle", "package_manager", files=["build.gradle", "build.gradle.kts"]),
    _rule("bundler", "Bundler", "package_manager", files=["Gemfile.lock"]),
    _rule("composer", "Composer", "package_manager", files=["composer.lock"]),
]
#: Categories (types of rules) to start with: (type, is_component, is_primary_tech, create_edges).
CATEGORIES = [("database", True, False, True), ("hosting", True, False, False), ("cloud", False, False, False), ("language", False, True, None), ("framework", False, True, None), ("tool", False, False, None), ("ci", False, False, None), ("test", False, False, None), ("library", False, False, None), ("data", False, False, None), ("ai", False, False, None), ("orm", False, False, None), ("messaging", True, False, True), ("service", True, False, True), ("monitoring", False, False, None), ("package_manager", False, False, None)]
#: Ecosystems to start with.
ECOSYSTEMS = [
    {"name": "node", "component_types": ["nodejs", "deno", "nx"], "techs": ["nodejs", "typescript"], "languages": ["JavaScript", "TypeScript"]},
    {"name": "python", "component_types": ["python"], "techs": ["python"], "languages": ["Python"]},
    {"name": "jvm", "component_types": ["maven", "gradle"], "techs": ["java", "spring"], "languages": ["Java", "Kotlin", "Scala"]},
    {"name": "dotnet", "component_types": ["dotnet"], "techs": ["dotnet"], "languages": ["C#"]},
    {"name": "go", "component_types": ["golang"], "techs": ["golang"], "languages": ["Go"]},
    {"name": "rust", "component_types": ["rust"], "techs": ["rust"], "languages": ["Rust"]},
    {"name": "ruby", "component_types": ["ruby"], "techs": ["ruby"], "languages": ["Ruby"]},
    {"name": "php", "component_types": ["php"], "techs": ["php"], "languages": ["PHP"]},
    {"name": "native", "component_types": ["cplusplus", "msbuild-cpp"], "techs": ["cplusplus"], "languages": ["C", "C++"]},
]


class Rules:
    """The parts of a rule set, each in the form its join takes."""

    def __init__(self, rules: Sequence[dict] = STARTER, only: Sequence[str] = ()):
        self.rules = [r for r in rules if not only or r["tech"] in only]
        deps = [(r["tech"], d["type"], d["name"]) for r in self.rules for d in r.get("dependencies") or [] if d.get("type") and d.get("name")]
        self.exact = [(t, k, p) for t, k, p in deps if not (len(p) > 2 and p.startswith("/") and p.endswith("/"))]
        self.regexes = [(t, k, p[1:-1]) for t, k, p in deps if len(p) > 2 and p.startswith("/") and p.endswith("/")]
        # Package managers' files speak only where nothing else has named the technology: the second pass over names.
        late = [r for r in self.rules if r.get("type") == "package_manager"]
        self.late_names = [(r["tech"], f) for r in late for f in r.get("files") or [] if "/" not in f and not any(c in f for c in "*?")]
        files = [(r["tech"], f) for r in self.rules if r.get("type") != "package_manager" for f in r.get("files") or []]
        self.directories = [(t, "/" + f.strip("/")) for t, f in files if "/" in f]
        self.globs = [(t, f) for t, f in files if "/" not in f and any(c in f for c in "*?")]
        self.names = [(t, f) for t, f in files if "/" not in f and not any(c in f for c in "*?")]
        self.extensions = [(r["tech"], e) for r in self.rules for e in r.get("extensions") or []]
        self.variables = [(r["tech"], v if isinstance(v, str) else v.get("name", "")) for r in self.rules for v in r.get("dotenv") or []]
        self.content = []
        for k, r in enumerate(self.rules):
            for c in r.get("content") or []:
                base = {"tech": r["tech"], "rule_order": k, "kind": c.get("type", "regex"), "pattern": c.get("pattern", ""), "path": c.get("path", ""), "value": c.get("value")}
                self.content += [base | {"ext": e} for e in c.get("extensions") or r.get("extensions") or []] + [base | {"file": f} for f in c.get("files") or []]

    def table(self, spark: SparkSession) -> DataFrame:
        """One row per rule: (tech, name, type, is_component, is_primary_tech, rule_order)."""
        rows = [(r["tech"], r.get("name", r["tech"]), r["type"], r.get("is_component"), r.get("is_primary_tech"), k) for k, r in enumerate(self.rules)]
        return spark.createDataFrame(rows, "tech string, name string, type string, is_component boolean, is_primary_tech boolean, rule_order int")

    def exact_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.exact, "tech string, dep_type string, pattern string")

    def names_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.names, "tech string, pattern string")

    def late_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.late_names, "tech string, pattern string")


def ecosystem_tables(spark: SparkSession, ecosystems: Sequence[dict] = ECOSYSTEMS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(type, ecosystem), (tech, ecosystem) and (language, ecosystem)."""
    parts = (("component_types", "type"), ("techs", "tech"), ("languages", "language"))
    return tuple(spark.createDataFrame([(x, e["name"]) for e in ecosystems for x in e[key]], f"{name} string, ecosystem string") for key, name in parts)
