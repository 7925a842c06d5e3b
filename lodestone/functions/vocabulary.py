"""Word lists, weights and limits of the data model."""

# Extensions, names and folders that decide what is ingested.
PARSEABLE = [".py", ".js", ".jsx", ".ts", ".tsx", ".mts", ".cts"]
READABLE = PARSEABLE + (
    ".mjs .cjs .json .md .markdown .rst .txt .yml .yaml .toml .ini .cfg .conf .env .example .sh .bash .ps1 .bat .sql .html"
    " .css .scss .gradle .properties .xml .gitignore .dockerignore"
).split()
READABLE_NAMES = (
    "Dockerfile Makefile LICENSE README CHANGELOG Procfile .gitignore .dockerignore .env .env.example".split()
)
DOCUMENTS = [".md", ".markdown", ".txt", ".rst", ".text", ".pdf"]
SKIPPED = (
    ".git node_modules graphify-out __pycache__ dist .venv venv build .next .gradle target coverage out .claude .idea"
    " .vscode .pytest_cache .mypy_cache .tox .cache"
).split()
SKIPPED_FOR_CAPTURE = [*SKIPPED, "site-packages"]
MANIFESTS = (
    "package.json pyproject.toml setup.cfg requirements.txt go.mod Cargo.toml pom.xml build.gradle Gemfile tsconfig.json"
    " vite.config.js Makefile Procfile .env.example env.example"
).split()
INTERESTING = (
    r"(?i)^(readme|changelog|contributing|license|architecture)|\.(md|rst)$|^(claude|agents)\.md$"
    r"|^dockerfile|^docker-compose.*\.ya?ml$|^jenkinsfile$|^\.gitlab-ci\.ya?ml$|^capacitor\.config\.json$"
)
WORKFLOW = r"(?i)(^|/)\.github/workflows/.+\.ya?ml$"
MOST_SOURCE_BYTES, MOST_PDF_BYTES = 2 * 1024 * 1024, 40 * 1024 * 1024
MOST_CAPTURED_BYTES, CAPTURE_BUDGET = 512 * 1024, 2 * 1024 * 1024
MINIFIED_LENGTH, MINIFIED_LINE = 20000, 400

# Relations and their weights in a layout, kinds of entities.
RELATION_WEIGHT = {
    "contains": 1.0, "method": 1.0, "inherits": 1.0, "calls": 0.9, "rationale_for": 0.6, "references": 0.5,
    "indirect_call": 0.4, "imports_from": 0.35, "imports": 0.35, "imports_type": 0.18,
}
OTHER_WEIGHT, INFERRED_FACTOR = 0.5, 0.5
STRUCTURAL = ["contains", "method", "rationale_for", "subsection"]
KINDS = ["code", "document", "rationale", "concept"]
ENTRY_VERBS = r"_(get|post|put|patch|delete|route|command|task|middleware|websocket|on_event|fixture|test)$"
RUNTIME_HOOK = r"^\.?__\w+__\(\)$|^\.?(main|setup|teardown)\(\)$"
PYTHON_STDLIB = (
    "typing abc enum collections dataclasses os sys json re time datetime asyncio uuid pathlib functools itertools"
    " threading subprocess logging argparse"
).split()

# Retrieval.
STOP_WORDS = (
    "a an and are as at be but by for from has have how i if in is it its of on or that the their then there these they"
    " this to was were what when where which who will with you your"
).split()
BM25_K1, BM25_B, COVERAGE_BONUS = 1.2, 0.75, 0.35
LEAST_PASSAGE, MOST_PASSAGE, LEAST_LETTERS = 220, 1600, 15
GENERIC_NAMES = (
    "get set run main init app api index test tests data config setup start stop build make load save read write list add"
    " new open close call send post put delete update create remove find item items name value type file files path paths"
    " node nodes edge edges key keys size count total result results error errors state status page next prev use util"
    " utils lib src"
).split()

# Retention of builds and of recent queries and files.
MOST_VERSIONS, MOST_BUILDS, MOST_BYTES = 3, 8, 120 * 1024 * 1024
MOST_QUERIES, MOST_FILES = 8, 12
