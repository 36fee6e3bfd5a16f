"""Lists, tables and patterns that results depend on. Stated as they are, in one place."""

from __future__ import annotations

# Words that carry no meaning for search (fixed values).
STOP_WORDS = (
    "the", "a", "an", "is", "in", "it", "of", "to", "and", "or",
    "for", "with", "this", "that", "be", "are", "was", "were",
    "import", "from", "return", "if", "else", "elif", "class",
    "def", "function", "const", "let", "var", "true", "false",
    "none", "null", "self", "type", "pass", "print",
)

# Suffixes of files that are indexed (fixed values). ".env.example" is a whole file name, not a suffix.
SUPPORTED_SUFFIXES = (
    ".py", ".js", ".ts", ".jsx", ".tsx",
    ".go", ".rs", ".java", ".cpp", ".c",
    ".rb", ".php", ".cs", ".swift",
    ".html", ".css", ".scss",
    ".json", ".yaml", ".yml", ".toml", ".env.example",
    ".md", ".txt", ".sh",
)

# Folders that are never entered (fixed values).
IGNORED_DIRS = (
    ".git",
    "node_modules", "__pycache__", ".venv", "venv", "env", ".env",
    ".pytest_cache", ".mypy_cache",
    "dist", "build", ".next", ".nuxt", "coverage", ".turbo",
    "target", ".gradle", "out", "classes",
    "bin", "obj", ".vs", "packages",
    "vendor",
    ".bundle",
    "tmp", "temp", "logs", ".cache",
)

MAX_FILE_BYTES = 1_000_000
READ_CHARS = 50_000
SNIFF_BYTES = 8192
CHUNK_LINES, PLAIN_LINES = 60, 200
FILE_KEYWORDS, QUERY_KEYWORDS, FALLBACK_KEYWORDS = 20, 10, 5
SYMBOL_BOOST, VECTOR_BOOST, VECTOR_GATE = 5, 3, 0.3
LEAST_SCORE, CONTEXT_CHARS, TOP_FILES, VECTOR_HITS, SEARCH_HITS = 0.2, 24_000, 5, 10, 50
FILE_CHARS, MAP_FILES, MAP_SYMBOLS = 8000, 150, 12
RERANK_FILES, REPORT_ENTRIES, SUMMARY_CHARS = 10, 15, 2000
SCHEMA_VERSION = 7

# First pattern that matches a line wins; the group "name" is the symbol (fixed values).
SYMBOL_PATTERNS = {
    ".py": [
        (r"^(?P<indent>\s*)def (?P<name>\w+)\s*\(", "function"),
        (r"^(?P<indent>\s*)async def (?P<name>\w+)\s*\(", "function"),
        (r"^(?P<indent>)class (?P<name>\w+)[\s:(]", "class"),
    ],
    ".js": [
        (r"function (?P<name>\w+)\s*\(", "function"),
        (r"const (?P<name>\w+)\s*=\s*(async\s*)?\(", "function"),
        (r"class (?P<name>\w+)[\s{]", "class"),
    ],
    ".jsx": [
        (r"function (?P<name>\w+)\s*\(", "function"),
        (r"const (?P<name>\w+)\s*=\s*(async\s*)?\(", "function"),
        (r"class (?P<name>\w+)[\s{]", "class"),
    ],
    ".ts": [
        (r"function (?P<name>\w+)\s*[(<]", "function"),
        (r"const (?P<name>\w+)\s*=\s*(async\s*)?\(", "function"),
        (r"class (?P<name>\w+)[\s{<]", "class"),
        (r"interface (?P<name>\w+)[\s{<]", "interface"),
        (r"type (?P<name>\w+)\s*=", "type"),
    ],
    ".tsx": [
        (r"function (?P<name>\w+)\s*[(<]", "function"),
        (r"const (?P<name>\w+)\s*=\s*(async\s*)?\(", "function"),
        (r"class (?P<name>\w+)[\s{<]", "class"),
        (r"interface (?P<name>\w+)[\s{<]", "interface"),
    ],
    ".go": [
        (r"^func (?P<name>\w+)\s*\(", "function"),
        (r"^func \(\w+ \*?\w+\) (?P<name>\w+)\s*\(", "function"),
        (r"^type (?P<name>\w+) struct", "type"),
        (r"^type (?P<name>\w+) interface", "interface"),
    ],
    ".java": [
        (r"(public|private|protected|static|final|\s)+[\w<>\[\]]+\s+(?P<name>\w+)\s*\(", "function"),
        (r"\bclass\s+(?P<name>\w+)[\s{<]", "class"),
        (r"\binterface\s+(?P<name>\w+)[\s{<]", "interface"),
        (r"\benum\s+(?P<name>\w+)[\s{]", "function"),
        (r"\brecord\s+(?P<name>\w+)\s*[\s({]", "function"),
    ],
    ".cs": [
        (r"(public|private|protected|internal|static|virtual|override|abstract|\s)+[\w<>\[\]?]+\s+(?P<name>\w+)\s*\(", "function"),
        (r"\bclass\s+(?P<name>\w+)[\s:{<]", "class"),
        (r"\binterface\s+(?P<name>\w+)[\s:{<]", "interface"),
        (r"\benum\s+(?P<name>\w+)[\s{]", "function"),
        (r"\brecord\s+(?P<name>\w+)[\s({]", "function"),
        (r"\bdelegate\s+[\w<>\[\]]+\s+(?P<name>\w+)\s*\(", "function"),
    ],
    ".rs": [
        (r"^pub\s+(async\s+)?fn\s+(?P<name>\w+)\s*[(<]", "function"),
        (r"^(async\s+)?fn\s+(?P<name>\w+)\s*[(<]", "function"),
        (r"^pub\s+struct\s+(?P<name>\w+)[\s{<]", "function"),
        (r"^struct\s+(?P<name>\w+)[\s{<]", "function"),
        (r"^pub\s+trait\s+(?P<name>\w+)[\s{<]", "function"),
        (r"^pub\s+enum\s+(?P<name>\w+)[\s{<]", "function"),
        (r"^impl\s+(?P<name>\w+)[\s{<]", "function"),
    ],
    ".rb": [
        (r"^\s*def\s+(?P<name>\w+[\?!]?)", "function"),
        (r"^\s*class\s+(?P<name>\w+)", "class"),
        (r"^\s*module\s+(?P<name>\w+)", "function"),
    ],
    ".php": [
        (r"function\s+(?P<name>\w+)\s*\(", "function"),
        (r"class\s+(?P<name>\w+)[\s{]", "class"),
        (r"interface\s+(?P<name>\w+)[\s{]", "interface"),
        (r"trait\s+(?P<name>\w+)[\s{]", "function"),
    ],
    ".c": [
        (r"^[\w\s\*]+\s+(?P<name>\w+)\s*\([^;]", "function"),
    ],
    ".cpp": [
        (r"^[\w\s\*:<>]+\s+(?P<name>\w+)\s*\([^;]", "function"),
        (r"\bclass\s+(?P<name>\w+)[\s:{]", "class"),
        (r"\bstruct\s+(?P<name>\w+)[\s:{]", "function"),
    ],
}

# Group 1 is what is imported (fixed values).
_SCRIPT_IMPORTS = [r"""import\s+.*?\s+from\s+['"]([^'"]+)['"]""", r"""require\s*\(\s*['"]([^'"]+)['"]\s*\)"""]
IMPORT_PATTERNS = {
    ".py": [r"(?m)^\s*import\s+([\w.]+)", r"(?m)^\s*from\s+([\w.]+)\s+import"],
    ".js": _SCRIPT_IMPORTS,
    ".ts": _SCRIPT_IMPORTS,
    ".go": [r"""["']([^"']+)["']"""],
    ".java": [r"(?m)^\s*import\s+([\w.]+);"],
    ".cs": [r"(?m)^\s*using\s+([\w.]+);"],
    ".rb": [r"""(?m)^\s*require\s+['"]([^'"]+)['"]"""],
    ".php": [r"(?m)^\s*use\s+([\w\\]+);"],
    ".jsx": _SCRIPT_IMPORTS,
    ".tsx": _SCRIPT_IMPORTS,
    ".mjs": _SCRIPT_IMPORTS,
    ".cjs": _SCRIPT_IMPORTS,
}
PY_TARGETS = (".py", "/__init__.py", "")
SCRIPT_TARGETS = ("", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js")

# Categories of symbols by path segment and name suffix (fixed values).
DTO_NAMES = ("dto", "request", "response", "entity", "schema", "model", "input", "output", "payload")
DTO_DIRS = ("dto", "dtos", "models", "entities", "schemas")
ROUTE_DIRS = ("routes", "routers", "controllers", "handlers", "endpoints", "api")
SERVICE_DIRS = ("services", "service")
TEST_DIRS = ("tests", "test", "__tests__", "spec", "specs")
CONFIG_DIRS = ("config", "configs", "configuration")
MIDDLEWARE_DIRS = ("middleware", "middlewares")
ROUTE_TEXTS = (
    r"(?i)@(?:app|router|blueprint)\.(get|post|put|patch|delete|route)\s*\(",
    r"@(?:Get|Post|Put|Patch|Delete|Request)Mapping\s*\(",
    r"(?:app|router)\.(get|post|put|patch|delete|use|all)\s*\(",
)

# Suffix to language (fixed values).
LANGUAGES = {
    "py": "Python", "js": "JavaScript", "ts": "TypeScript", "jsx": "React JSX",
    "tsx": "React TSX", "go": "Go", "java": "Java", "cs": "C#", "rs": "Rust",
    "rb": "Ruby", "php": "PHP", "c": "C", "cpp": "C++", "h": "C/C++ Header",
    "hpp": "C++ Header", "swift": "Swift", "kt": "Kotlin", "scala": "Scala",
    "ex": "Elixir", "exs": "Elixir Script", "dart": "Dart", "lua": "Lua",
    "sh": "Shell", "bash": "Bash", "zsh": "Zsh", "ps1": "PowerShell",
    "sql": "SQL", "graphql": "GraphQL", "gql": "GraphQL", "proto": "Protocol Buffers",
    "yaml": "YAML", "yml": "YAML", "toml": "TOML", "json": "JSON",
    "xml": "XML", "html": "HTML", "css": "CSS", "scss": "SCSS", "less": "LESS",
    "md": "Markdown", "rst": "reStructuredText", "vue": "Vue SFC", "svelte": "Svelte",
}

# Architecture: name, description, folders, marker files (fixed values).
ARCHITECTURES = (
    ("MVC (Model-View-Controller)", ("controllers", "models", "views"), ()),
    ("Layered Architecture", ("services", "repositories", "controllers"), ()),
    ("Clean Architecture", ("domain", "usecases", "adapters", "entities"), ()),
    ("Hexagonal (Ports & Adapters)", ("ports", "adapters", "domain"), ()),
    ("Modular / Feature-based", ("modules", "features", "packages"), ()),
    ("Microservices / Multi-service", ("gateway", "services", "proto"), ("docker-compose.yml", "docker-compose.yaml", "Dockerfile")),
    ("Monorepo", ("packages", "apps", "libs"), ("lerna.json", "pnpm-workspace.yaml", "turbo.json", "nx.json")),
    ("Serverless", ("functions", "lambdas"), ("serverless.yml", "serverless.yaml", "template.yaml", "sam.yaml")),
)

# Entry points by file name, in order (fixed values).
ENTRY_POINTS = (
    ("main.py", "Python main entry point"),
    ("app.py", "Python application entry"),
    ("manage.py", "Django management script"),
    ("wsgi.py", "WSGI application entry"),
    ("asgi.py", "ASGI application entry"),
    ("__main__.py", "Python package entry point"),
    ("cli.py", "CLI entry point"),
    ("server.py", "Server entry point"),
    ("index.js", "JavaScript entry point"),
    ("index.ts", "TypeScript entry point"),
    ("server.js", "Node.js server entry"),
    ("server.ts", "Node.js server entry"),
    ("app.js", "Express/Node app entry"),
    ("app.ts", "Express/Node app entry"),
    ("main.go", "Go main entry point"),
    ("Application.java", "Spring Boot entry"),
    ("main.rs", "Rust main entry point"),
    ("lib.rs", "Rust library entry point"),
)
GUARDED_SCRIPT = "Python script with __main__ guard"

# Marker files and folders of infrastructure: category, name (fixed values).
INFRASTRUCTURE = (
    ("Dockerfile", "containerization", "Docker"),
    ("docker-compose.yml", "containerization", "Docker Compose"),
    ("docker-compose.yaml", "containerization", "Docker Compose"),
    (".dockerignore", "containerization", "Docker"),
    (".github/workflows", "ci_cd", "GitHub Actions"),
    (".gitlab-ci.yml", "ci_cd", "GitLab CI"),
    ("Jenkinsfile", "ci_cd", "Jenkins"),
    (".circleci/config.yml", "ci_cd", "CircleCI"),
    (".travis.yml", "ci_cd", "Travis CI"),
    ("bitbucket-pipelines.yml", "ci_cd", "Bitbucket Pipelines"),
    ("azure-pipelines.yml", "ci_cd", "Azure Pipelines"),
    ("k8s/", "orchestration", "Kubernetes"),
    ("kubernetes/", "orchestration", "Kubernetes"),
    ("helm/", "orchestration", "Helm Charts"),
    ("Chart.yaml", "orchestration", "Helm Charts"),
    ("terraform/", "iac", "Terraform"),
    ("main.tf", "iac", "Terraform"),
    (".eslintrc", "quality", "ESLint"),
    (".eslintrc.js", "quality", "ESLint"),
    (".eslintrc.json", "quality", "ESLint"),
    ("eslint.config.js", "quality", "ESLint"),
    (".prettierrc", "quality", "Prettier"),
    (".flake8", "quality", "Flake8"),
    ("pyproject.toml", "quality", "Python Project Config"),
    ("ruff.toml", "quality", "Ruff"),
    ("vercel.json", "deployment", "Vercel"),
    ("netlify.toml", "deployment", "Netlify"),
    ("fly.toml", "deployment", "Fly.io"),
    ("Procfile", "deployment", "Heroku"),
    (".env.example", "config", "Environment Config"),
    (".env.sample", "config", "Environment Config"),
    ("Makefile", "build", "Make"),
)

# Frameworks by a substring of a manifest (fixed values).
FRAMEWORKS = {
    "package.json": {
        "next": "Next.js", "react": "React", "vue": "Vue.js", "angular": "Angular",
        "express": "Express", "fastify": "Fastify", "nestjs": "NestJS", "nuxt": "Nuxt",
        "svelte": "Svelte", "remix": "Remix", "gatsby": "Gatsby",
        "tailwindcss": "Tailwind CSS", "prisma": "Prisma", "drizzle": "Drizzle",
    },
    "requirements.txt": {
        "fastapi": "FastAPI", "django": "Django", "flask": "Flask",
        "sqlalchemy": "SQLAlchemy", "celery": "Celery", "pydantic": "Pydantic",
        "pytest": "Pytest", "pandas": "Pandas", "numpy": "NumPy",
        "tensorflow": "TensorFlow", "torch": "PyTorch",
    },
    "Cargo.toml": {"actix": "Actix", "rocket": "Rocket", "tokio": "Tokio", "serde": "Serde"},
    "go.mod": {"gin-gonic": "Gin", "echo": "Echo", "fiber": "Fiber", "chi": "Chi"},
}
DEPENDENCY_FILES = (
    "package.json", "requirements.txt", "Pipfile", "pyproject.toml",
    "Cargo.toml", "go.mod", "pom.xml", "build.gradle", "Gemfile",
    "composer.json", "mix.exs", "pubspec.yaml",
)

# Names of test frameworks by suffix (fixed values).
TEST_FRAMEWORKS = {
    ".py": ("pytest", "unittest", "nose", "hypothesis"),
    ".js": ("jest", "mocha", "vitest", "ava", "tape", "jasmine"),
    ".ts": ("jest", "mocha", "vitest", "jasmine"),
    ".go": ("testing",),
    ".java": ("junit", "testng", "mockito"),
    ".rs": ("test",),
    ".rb": ("rspec", "minitest"),
    ".cs": ("xunit", "nunit", "mstest"),
}

# File names that stand for their module (fixed values).
REPRESENTATIVE_NAMES = (
    "main.py", "app.py", "server.py", "index.py", "manage.py", "__main__.py",
    "index.ts", "index.js", "app.ts", "app.js", "server.ts", "server.js",
    "main.go", "main.rs", "Main.java", "Program.cs", "Startup.cs",
    "index.tsx", "index.jsx", "app.tsx", "app.jsx",
)

# Phrases that tell the kind of a question (fixed values).
AGGREGATE_WORDS = ("how many", "count", "list all", "list every", "show all", "show every")
OVERVIEW_WORDS = (
    "overview", "summary", "summarize", "what is this", "what does this",
    "theme", "purpose", "about this", "describe this", "this project",
    "this codebase", "this repo", "tech stack", "what language", "what framework",
)
CATEGORY_WORDS = (
    ("dto", "dto"), ("dtos", "dto"), ("model", "dto"), ("models", "dto"),
    ("schema", "dto"), ("entity", "dto"), ("entities", "dto"),
    ("route", "route"), ("routes", "route"), ("endpoint", "route"), ("endpoints", "route"),
    ("api", "route"), ("controller", "route"), ("controllers", "route"),
    ("test", "test"), ("tests", "test"), ("spec", "test"), ("specs", "test"),
    ("service", "service"), ("services", "service"),
    ("config", "config"), ("configuration", "config"),
    ("middleware", "middleware"),
)
GENERIC_SYMBOLS = ("Ok", "BadRequest", "NotFound", "NoContent", "Unauthorized", "CreatedAtAction", "ArgumentNullException")

# Addresses of repositories: with host, and the short form (fixed values).
REPOSITORY = r"^(?:https?://)?(?:www\.)?{host}/([a-zA-Z0-9_.-]+/[a-zA-Z0-9_.-]+?)(?:\.git)?/?$"
SHORT_REPOSITORY = r"^([a-zA-Z0-9_.-]+/[a-zA-Z0-9_.-]+)$"

# Patterns of dependency manifests, and keys of a Cargo manifest that are no crates (fixed values).
REQUIREMENT_END = r"[>=<!\[]"
PYPROJECT_LIST = r"(?s)dependencies\s*=\s*\[(.*?)\]"
GO_MODULE = r"(?m)^\s+([\w./\-]+)\s+v"
CARGO_KEY = r"(?m)^(\w[\w-]*)\s*="
CARGO_OTHER = ("name", "version", "edition", "authors", "description", "license", "repository")
GEM = r"""gem\s+['"]([^'"]+)['"]"""

# Text in a fenced block (fixed value).
FENCED = r"(?s)```(?:json)?\s*\n?(.*?)\n?```"

# Least shares of test files, in percent, with their labels (fixed values).
RATIO_LABELS = ((80, "Strong"), (50, "Good"), (25, "Moderate"))

# Confidence: least ratio of the best score alone, or with so many ranked files (fixed values).
HIGH_RATIO, HIGH_RATIO_OF_THREE, MEDIUM_RATIO = 0.15, 0.08, 0.05
