"""Fixed values that results depend on: status codes, maps, lists and patterns."""

from __future__ import annotations

CONFLICT_STATUS = ["UU", "AA", "DD", "AU", "UA", "DU", "UD"]
# Substrings of a lower-cased path that keep a file out of detection.
DETECT_EXCLUDED = [".git/", ".gitignore", "package-lock.json", "yarn.lock", ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".ico", ".svg", ".exe", ".dll", ".so", ".dylib", ".o", ".obj", ".zip", ".tar", ".gz", ".rar", ".7z"]
# Substrings of a path, and extensions, that keep a file out of a payload.
PAYLOAD_EXCLUDED = ["node_modules/", ".git/", "vendor/", "target/", "build/", "dist/", ".DS_Store", "*.min.js", "*.min.css", "package-lock.json", "yarn.lock", "Cargo.lock", "go.sum"]
BINARY_EXTENSIONS = [".jpg", ".jpeg", ".png", ".gif", ".bmp", ".svg", ".ico", ".mp3", ".mp4", ".avi", ".mov", ".wav", ".pdf", ".zip", ".tar", ".gz", ".exe", ".dll", ".so", ".dylib", ".jar", ".war", ".ear", ".class"]
# Languages by extension: for detection (other: text), for payloads (other: text) and for applying (other: empty).
DETECT_LANGUAGE = {
    "go": [".go"], "javascript": [".js", ".jsx"], "typescript": [".ts", ".tsx"], "python": [".py"], "java": [".java"], "c": [".c", ".h"], "cpp": [".cpp", ".hpp"], "csharp": [".cs"],
    "ruby": [".rb"], "php": [".php"], "rust": [".rs"], "swift": [".swift"], "json": [".json"], "xml": [".xml"], "yaml": [".yaml", ".yml"], "markdown": [".md"], "text": [".txt"],
}
PAYLOAD_LANGUAGE = {
    "go": [".go"], "javascript": [".js", ".mjs"], "typescript": [".ts"], "python": [".py"], "java": [".java"], "c": [".c"], "cpp": [".cpp", ".cc", ".cxx"], "header": [".h", ".hpp"], "rust": [".rs"],
    "ruby": [".rb"], "php": [".php"], "swift": [".swift"], "kotlin": [".kt", ".kts"], "scala": [".scala"], "shell": [".sh", ".bash"], "yaml": [".yaml", ".yml"], "json": [".json"], "xml": [".xml"],
    "html": [".html", ".htm"], "css": [".css"], "scss": [".scss", ".sass"], "markdown": [".md", ".markdown"], "sql": [".sql"], "dockerfile": [".dockerfile"], "makefile": [".makefile"],
}
TEXT_EXTENSIONS = [".go", ".js", ".ts", ".py", ".java", ".c", ".cpp", ".h", ".hpp", ".css", ".html", ".xml", ".json", ".yaml", ".yml", ".toml", ".md", ".txt", ".sh", ".bat", ".ps1", ".sql", ".php", ".rb", ".rs", ".kt", ".swift", ".dart", ".scala", ".clj", ".hs", ".ml", ".fs", ".r", ".m", ".pl", ".lua", ".vim", ".cfg", ".conf", ".ini", ".properties"]
# Patterns whose matches are redacted, in this order.
REDACTED = [
    r"sk-ant-[a-zA-Z0-9_-]+",
    r"ghp_[a-zA-Z0-9]{30,40}",
    r"gho_[a-zA-Z0-9]{30,40}",
    r"Bearer\s+[a-zA-Z0-9_.-]+",
    r"(?i)password\s*[:=]\s*[^\s]+",
    r"(?i)api[_-]?key\s*[:=]\s*[^\s]+",
    r"(?i)secret\s*[:=]\s*[^\s,]+",
]
# Formatters in order of preference, with their extensions.
FORMATTERS = [
    ("gofmt", ["go"]), ("goimports", ["go"]), ("prettier", ["js", "jsx", "ts", "tsx", "json", "css", "scss", "md"]), ("eslint", ["js", "jsx", "ts", "tsx"]), ("black", ["py"]),
    ("autopep8", ["py"]), ("isort", ["py"]), ("rustfmt", ["rs"]), ("jq", ["json"]), ("yamlfmt", ["yaml", "yml"]),
]
# Files that mark a project's type; the first that is found in this order decides, TypeScript over JavaScript.
PROJECT_MARKERS = [
    ("go.mod", "go"), ("go.sum", "go"), ("tsconfig.json", "typescript"), ("package.json", "javascript"), ("pyproject.toml", "python"), ("setup.py", "python"),
    ("requirements.txt", "python"), ("Cargo.toml", "rust"), ("Cargo.lock", "rust"),
]
UNSAFE_TOKENS = ["..", "|", "&", ";", "$", "`", "\\", "//"]
UNSAFE_PREFIXES = ["/etc/", "/usr/", "/bin/", "/sbin/", "/root/", "/home/", "/var/", "/tmp/", "/proc/", "/sys/"]
LANGUAGES = ["go", "javascript", "typescript", "python", "java", "c", "cpp", "csharp", "ruby", "php", "rust", "swift", "kotlin", "scala", "json", "yaml", "xml", "markdown", "text", "shell", "bash", "css", "scss", "html", "sql", "dockerfile", "makefile", "header"]
NPM_SCRIPTS = ["test", "build", "lint", "type-check", "format"]
MAKE_TARGETS = ["test", "build", "lint", "check", "validate", "format"]
SKIPPED_FOLDERS = ["node_modules/", "vendor/", "target/", ".git/", "dist/", "build/"]
VALIDATED_EXTENSIONS = [".go", ".js", ".ts", ".tsx", ".jsx", ".py", ".rs", ".java", ".c", ".cpp", ".h", ".hpp", ".json", ".yaml", ".yml"]
BAD_DECLARATIONS = ["var = ", ":= var", "var {", "const = "]
TYPE_MISMATCHES = ["string = int", "int = string", "bool = string", "string = bool"]
# Substrings of a lower-cased error, and whether it may be retried; the first that holds decides.
RETRY_RULES = [
    (["timeout", "deadline exceeded"], True), (["connection", "network"], True), (["rate limit", "too many requests", "429", "quota exceeded", "throttled"], True),
    (["500", "502", "503", "504", "internal server error", "service unavailable"], True), (["invalid", "not found", "unauthorized", "forbidden", "400", "401", "403"], False),
]
# Names of text files without an extension; those that begin with a dot have one by the rule for extensions, and never match.
TEXT_NAMES = ["Makefile", "Dockerfile", "README", "LICENSE", "CHANGELOG", "CONTRIBUTING", "AUTHORS", ".gitignore", ".gitattributes", ".editorconfig"]
# Languages by extension, for applying (other: empty).
APPLY_LANGUAGE = {"go": [".go"], "javascript": [".js"], "typescript": [".ts"], "python": [".py"], "java": [".java"], "c": [".c"], "cpp": [".cpp"], "csharp": [".cs"], "ruby": [".rb"], "php": [".php"], "rust": [".rs"]}
# Signs of Go code: what a syntax check rejects, what handles an error, what opens a control structure, what speaks for idiom.
GO_REJECTED = ["func (", "if {", ";;", "import ("]
GO_HANDLED = ["if err != nil", "return err", "log.Fatal", "panic"]
GO_CONTROL = ["if", "for", "switch", "select"]
GO_ERRORS = ["if err != nil", "return err", "return nil, err"]
GO_FUNCTION = r"^\s*func\s+(\w*\s*)?\w+\s*\([^)]*\).*"
GO_TYPE = r"^\s*type\s+\w+\s+(struct|interface).*"
PYTHON_CONTROL = ["if ", "for ", "while ", "def ", "class "]
# Limits of a payload: bytes, files, conflicts of a file and of all, bytes of a line, lines of context and of a hunk.
MAX_PAYLOAD, MAX_FILES, MAX_FILE_CONFLICTS, MAX_CONFLICTS, MAX_LINE, MAX_CONTEXT, MAX_HUNK_LINES, MAX_LINE_NUMBER = 10 * 1024 * 1024, 1000, 100, 5000, 10000, 50, 1000, 1000000
# Lines of context of a conflict, and those in a repository with more than so many files.
CONTEXT, LARGE_CONTEXT, LARGE_REPOSITORY = 5, 3, 1000
# Limits of a payload's metadata: files and conflicts it speaks of, characters of its version; bytes of a path and of a conflict's id once cleaned.
META_FILES, META_CONFLICTS, META_VERSION, CLEAN_PATH, CLEAN_ID = 1000, 5000, 20, 500, 100
# Messages of a payload's broken rules, by tag; the field and the limit are put in.
RULE_MESSAGES = {
    "required": "Field '%s' is required", "max": "Field '%s' exceeds maximum length of %s", "min": "Field '%s' is below minimum value of %s", "filepath": "Field '%s' contains invalid file path",
    "language": "Field '%s' contains unsupported language", "conflict_id": "Field '%s' contains invalid conflict ID format", "safe_content": "Field '%s' contains unsafe content",
    "repo_path": "Field '%s' contains invalid repository path", "gtfield": "Field '%s' must be greater than %s",
}
# Validation commands by type of project, in order: name, command, arguments, whether required.
COMMANDS = {
    "go": [("go_build", "go", "build ./...", True), ("go_test", "go", "test ./...", False), ("go_vet", "go", "vet ./...", False), ("gofmt", "gofmt", "-l .", False), ("staticcheck", "staticcheck", "./...", False), ("gosec", "gosec", "./...", False)],
    "typescript": [("typescript_check", "tsc", "--noEmit", True), ("eslint", "eslint", ".", False), ("jest", "jest", "", False)],
    "javascript": [("eslint", "eslint", ".", False), ("jest", "jest", "", False)],
    "python": [("python_syntax", "python3", "-m py_compile .", True), ("pytest", "pytest", ".", False), ("flake8", "flake8", ".", False), ("mypy", "mypy", ".", False), ("black_check", "black", "--check .", False), ("bandit", "bandit", "-r .", False)],
    "rust": [("cargo_build", "cargo", "build", True), ("cargo_test", "cargo", "test", False), ("cargo_clippy", "cargo", "clippy -- -D warnings", False), ("cargo_fmt_check", "cargo", "fmt -- --check", False)],
}
# Suggestions for a plain error: what its lower-cased text contains, and what to do.
ERROR_HINTS = [
    (["permission denied"], ["Check file permissions", "Run with appropriate privileges"]), (["network", "connection"], ["Check internet connection", "Verify network settings"]),
    (["not found"], ["Verify the path exists", "Check spelling and case sensitivity"]),
]
# Suggestions for an answer's status code.
STATUS_HINTS = {401: ["Check your API key", "Verify the API key has proper permissions"], 429: ["Wait before retrying", "Reduce request frequency"]} | {c: ["Retry the request", "Check API status page"] for c in (500, 502, 503, 504)}
# Whether an error of a kind may be recovered from; an answer's status decides for api.
RECOVERABLE = {"repository": True, "conflict": True, "filesystem": True, "validation": False, "authentication": True, "network": True, "configuration": True}
