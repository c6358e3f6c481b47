"""Column helpers for file paths and repository references."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gritlens.functions import text as X

# Which files are analysed, and under which language name.
SOURCE_EXTENSIONS = [
    ".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs", ".py", ".java", ".sql",
    ".json", ".env", ".yml", ".yaml", ".go", ".php", ".rb", ".sh",
]
IGNORED_DIRECTORIES = [
    "node_modules", ".git", ".github", "dist", "build", "coverage", ".venv",
    "venv", "env", "__pycache__", ".next", ".nuxt", ".idea", ".vscode",
    "vendor", "target", "bin", "obj", "tmp", "temp",
]
IGNORED_FILES = [
    "package-lock.json", "yarn.lock", "pnpm-lock.yaml", ".DS_Store", "Thumbs.db",
]
LANGUAGES = {
    ".ts": "typescript", ".tsx": "typescript",
    ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript",
    ".py": "python", ".java": "java", ".sql": "sql", ".json": "json",
    ".yml": "yaml", ".yaml": "yaml", ".go": "go", ".php": "php", ".rb": "ruby", ".sh": "shell",
}
FETCH_SUFFIXES = [
    ".js", ".ts", ".jsx", ".tsx", ".mjs", ".cjs", ".py", ".java", ".go", ".sql",
    ".json", ".yaml", ".yml", ".env.example", "package.json", "requirements.txt",
]
FETCH_EXCLUDED = [
    "node_modules/", ".git/", "dist/", "build/", "vendor/", ".next/", ".nuxt/",
    "coverage/", ".min.js", ".min.css", "package-lock.json", "yarn.lock", "pnpm-lock.yaml",
]
JS_FILE = r"(?i)\.(js|jsx|ts|tsx|mjs|cjs)$"
REPO_URL = r"github\.com/([a-zA-Z0-9_.-]+)/([a-zA-Z0-9_.-]+)"
REPO_SHORT = r"^([a-zA-Z0-9_.-]+)/([a-zA-Z0-9_.-]+)$"
REPO_URL_OR_SSH = r"(?i)github\.com[/:]([a-zA-Z0-9_\-.]+)/([a-zA-Z0-9_\-.]+)"


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(name: Column) -> Column:
    """From the last dot on, lower-cased; ``''`` without a dot or if only leading."""
    body = F.substring_index(name, ".", -1)
    stem_length = F.length(name) - F.length(body) - 1
    return F.when(
        (stem_length > 0) & (name != ".."), F.concat(F.lit("."), F.lower(body))
    ).otherwise(F.lit(""))


def normalise(path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments; leading ``..`` stay on relative paths."""
    absolute = F.startswith(path, F.lit("/"))
    segments = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))

    def push(acc, seg):
        top = F.try_element_at(acc, F.lit(-1))
        pops = (seg == "..") & F.coalesce(top != "..", F.lit(False))
        dropped = (seg == "..") & absolute & (F.size(acc) == 0)
        return (
            F.when(pops, F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
            .when(dropped, acc)
            .otherwise(F.array_append(acc, seg))
        )

    folded = F.aggregate(segments, F.array().cast("array<string>"), push)
    joined = F.array_join(folded, "/")
    body = F.when(absolute, F.concat(F.lit("/"), joined)).otherwise(joined)
    tail = F.when(
        F.endswith(path, F.lit("/")) & ~F.endswith(body, F.lit("/")) & (body != ""), F.lit("/")
    ).otherwise(F.lit(""))
    return F.when(body == "", F.lit(".")).otherwise(F.concat(body, tail))


def is_safe(path: Column) -> Column:
    """False for empty paths, absolute paths and paths that leave the root.

    Normalising knows only ``/``; back slashes are turned afterwards.
    """
    norm = F.translate(normalise(path), "\\", "/")
    plain = ~F.contains(path, F.lit("..")) & ~F.contains(path, F.lit("\\"))
    inside = (
        ~F.startswith(norm, F.lit("../"))
        & ~F.contains(norm, F.lit("/../"))
        & (norm != "..")
        & ~F.startswith(norm, F.lit("/"))
    )
    safe = F.when(plain, ~F.startswith(path, F.lit("/"))).otherwise(inside)
    return F.coalesce((path != "") & safe, F.lit(False))


def is_strictly_safe(path: Column) -> Column:
    """The upload check: no empty path, no ``..`` anywhere, no leading ``/``."""
    return F.coalesce(
        (path != "") & ~F.contains(path, F.lit("..")) & ~F.startswith(path, F.lit("/")),
        F.lit(False),
    )


def is_analysable(path: Column) -> Column:
    segments = F.split(F.translate(path, "\\", "/"), "/")
    parents = F.slice(segments, F.lit(1), F.size(segments) - 1)
    name = F.element_at(segments, -1)
    hidden = F.exists(
        parents,
        lambda d: F.lower(d).isin(IGNORED_DIRECTORIES) | F.startswith(d, F.lit(".")),
    )
    wanted = (
        F.startswith(name, F.lit(".env"))
        | name.isin("requirements.txt", "package.json")
        | extension(name).isin(SOURCE_EXTENSIONS)
    )
    return is_safe(path) & ~hidden & ~name.isin(IGNORED_FILES) & wanted


def is_fetch_candidate(path: Column) -> Column:
    """The older candidate filter: excluded fragments, then allowed suffixes."""
    low = F.lower(path)
    suffix = F.lit(False)
    for ext in FETCH_SUFFIXES:
        suffix = suffix | F.endswith(low, F.lit(ext))
    return F.coalesce(path != "", F.lit(False)) & ~X.contains_any(low, FETCH_EXCLUDED) & suffix


def language(path: Column) -> Column:
    name = F.lower(base_name(path))
    ext = extension(name)
    known = F.create_map(*[F.lit(v) for pair in LANGUAGES.items() for v in pair])
    return (
        F.when(F.startswith(name, F.lit(".env")), F.lit("env"))
        .when(name == "package.json", F.lit("json"))
        .when(name == "requirements.txt", F.lit("requirements"))
        .otherwise(F.coalesce(known[ext], F.lit("plaintext")))
    )


def is_js(path: Column) -> Column:
    return X.matches(path, JS_FILE)


def is_python(path: Column) -> Column:
    return F.endswith(path, F.lit(".py"))


def _owner_repo(owner: Column, repo: Column) -> Column:
    return F.when(owner != "", F.struct(owner.alias("owner"), repo.alias("repo")))


def repository_reference(ref: Column) -> Column:
    """``struct(owner, repo)`` of a URL or ``owner/repo``; NULL if neither."""
    clean = F.regexp_replace(X.trim(ref), r"/\z", "")

    def attempt(pattern):
        repo = F.regexp_replace(X.extract(clean, pattern, 2), r"\.git\z", "")
        return _owner_repo(X.extract(clean, pattern, 1), repo)

    return F.coalesce(attempt(REPO_URL), attempt(REPO_SHORT))


def repository_url_reference(ref: Column) -> Column:
    """The older reader: also ``github.com:owner/repo``, no short form."""
    clean = F.regexp_replace(F.regexp_replace(X.trim(ref), r"/+\z", ""), r"\.git\z", "")
    return _owner_repo(X.extract(clean, REPO_URL_OR_SSH, 1), X.extract(clean, REPO_URL_OR_SSH, 2))
