"""Paths, languages, file types, importance, projects, URLs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.text import _C, col

#: Extensions and languages of the three uses, each with what any other extension gives: the index of files, the
#: analysis of sources, the display of code.
LANGUAGES = {
    "index": (
        {".cs": "csharp", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".py": "python", ".go": "go", ".rs": "rust", ".java": "java", ".rb": "ruby", ".php": "php", ".c": "c", ".h": "c", ".cpp": "cpp", ".hpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".swift": "swift", ".scala": "scala", ".hs": "haskell", ".html": "html", ".htm": "html", ".css": "css", ".scss": "css", ".less": "css", ".json": "json", ".sh": "bash", ".bash": "bash", ".toml": "toml", ".ml": "ocaml", ".jl": "julia", ".axaml": "xml", ".xaml": "xml", ".csproj": "xml", ".props": "xml", ".targets": "xml"},
        "other",
    ),
    "analysis": ({".cs": "csharp", ".ts": "typescript", ".tsx": "tsx", ".js": "javascript", ".jsx": "javascript", ".py": "python", ".go": "go", ".rs": "rust", ".java": "java", ".rb": "ruby", ".php": "php", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".c": "c", ".h": "c", ".swift": "swift", ".scala": "scala", ".cshtml": "razor"}, ""),
    "display": (
        {".cs": "csharp", ".csproj": "xml", ".sln": "text", ".json": "json", ".xml": "xml", ".config": "xml", ".targets": "xml", ".props": "xml", ".xaml": "xml", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".py": "python", ".go": "go", ".java": "java", ".rs": "rust", ".rb": "ruby", ".md": "markdown", ".yml": "yaml", ".yaml": "yaml", ".sh": "bash", ".ps1": "powershell", ".sql": "sql", ".html": "html", ".css": "css"},
        "text",
    ),
}
#: Folders, extensions (ends of names) and names that the structure index leaves out, whatever their case.
SKIP_DIRS = ["node_modules", ".git", "bin", "obj", "dist", "build", ".next", "__pycache__", ".venv", "venv", "vendor", "target", ".idea", ".vs", ".vscode", "coverage", ".nyc_output", "tmp", "temp", ".cache", ".trae"]
SKIP_EXTENSIONS = [".dll", ".exe", ".so", ".dylib", ".bin", ".obj", ".o", ".a", ".lib", ".png", ".jpg", ".jpeg", ".gif", ".ico", ".svg", ".bmp", ".webp", ".woff", ".woff2", ".ttf", ".eot", ".otf", ".zip", ".tar", ".gz", ".bz2", ".7z", ".rar", ".lock", ".sum", ".snap"]
SKIP_NAMES = ["package-lock.json", "yarn.lock", "pnpm-lock.yaml", "gemfile.lock", "poetry.lock", "cargo.lock", ".ds_store", "thumbs.db"]
#: Folders (of that case) and extensions that the analysing index leaves out.
SKIP_DIRS_ANALYSIS = [".git", "node_modules", "bin", "obj", ".vs", "dist", "build", ".next", "coverage", ".nyc_output", "__pycache__", ".pytest_cache", "vendor", "target", ".gradle", ".trae"]
SKIP_EXTENSIONS_ANALYSIS = [".dll", ".exe", ".so", ".dylib", ".pdb", ".obj", ".o", ".png", ".jpg", ".jpeg", ".gif", ".ico", ".svg", ".woff", ".woff2", ".ttf", ".eot", ".zip", ".tar", ".gz", ".7z", ".rar", ".lock", ".map"]
#: Folders that the document reader leaves out.
SKIP_DIRS_DOCUMENTS = [".git", "node_modules", "__pycache__"]
#: Names of files at which programs start.
ENTRY_FILES = ["program.cs", "main.go", "index.ts", "index.js", "main.py", "app.tsx", "_app.tsx", "server.ts", "server.js", "app.js", "main.rs", "main.java", "main.cpp", "main.c"]
#: Fixed values of the structure index's file types, in the order in which they hold: names, folders, extensions, ends of names.
CONFIG_NAMES = ["makefile", "dockerfile", ".dockerignore", ".gitignore", ".editorconfig"]
DOTTED_SOURCES = [".cs", ".ts", ".js", ".py"]
TEST_FOLDERS, DOC_FOLDERS, GENERATED_FOLDERS = ["test", "tests", "spec"], ["doc", "docs"], ["generated"]
DOC_EXTENSIONS, CONFIG_EXTENSIONS = [".md", ".rst", ".txt", ".adoc"], [".json", ".yaml", ".yml", ".toml", ".ini", ".cfg", ".config", ".xml"]
GENERATED_ENDS = [".generated.cs", ".g.cs"]
#: Fixed values of the structure index's importance: by type, by name, by place.
IMPORTANCE_BY_TYPE, IMPORTANCE_OTHER = {"source": 5, "config": 4, "doc": 3, "test": 2}, 1
IMPORTANCE_BY_NAME = {10: ["program.cs", "main.go", "index.ts", "index.js", "app.tsx", "_app.tsx"], 8: ["startup.cs", "host.cs", "server.ts", "server.js"]}
IMPORTANCE_OF_SRC = 2
#: Fixed values of the analysing index's file types: type, and patterns of which the lower-cased path meets one; the first that holds.
ANALYSIS_TYPES = [("test", [r"test", r"spec"]), ("generated", [r"\.generated\.", r"\.g\.cs$", r"\.gen\.go$"]), ("doc", [r"\.md$", r"\.txt$", r"\.rst$"])]
#: Fixed values of the analysing index's importance: a start, added points by patterns of the lower-cased path, and bounds.
ANALYSIS_START, ANALYSIS_BOUNDS = 5, (1, 15)
ANALYSIS_POINTS = [(10, [r"(program\.cs|main\.go|index\.(ts|js|tsx)|app\.(tsx|jsx|py)|__init__\.py|setup\.py)$"]), (3, [r"src/", r"lib/", r"app/"])]
ANALYSIS_INTERFACE = (2, r"i\w+\.cs$", "interface")
ANALYSIS_TEST_POINTS, ANALYSIS_FIXED = -3, {"config": 3, "doc": 1}
#: Folders over modules, for the rule that looks one folder deeper.
MODULE_ROOTS = ["src", "test", "tests", "lib", "docs", "doc"]
#: Fixed values of the analysing index: kind of project by patterns of lower-cased paths, in order; technologies likewise, all that hold.
PROJECT_TYPES, PROJECT_OTHER = [("dotnet", r"\.csproj$"), ("node", r"^package\.json$"), ("go", r"^go\.mod$"), ("rust", r"^cargo\.toml$"), ("python", r"\.py$"), ("java", r"\.java$")], "generic"
TECHNOLOGIES, TECHNOLOGY_OTHER = [(".NET", r"\.csproj$"), ("React+TypeScript", r"\.tsx$"), ("Next.js", r"next\.config\."), ("Python", r"\.py$"), ("Go", r"\.go$")], "未知"
#: Fixed values of the structure index: project and technology by a file's name or extension.
DETECTORS = {".csproj": (".NET", "C# / .NET"), "package.json": ("Node.js", "JavaScript / TypeScript"), "go.mod": ("Go", "Go"), "cargo.toml": ("Rust", "Rust"), "pom.xml": ("Java Maven", "Java"), "build.gradle": ("Java Gradle", "Java / Kotlin"), "requirements.txt": ("Python", "Python"), "pyproject.toml": ("Python", "Python"), "dockerfile": ("Containerized", "Docker"), "cmakelists.txt": ("C/C++", "C / C++"), "makefile": ("C/C++", "C / C++ / Make")}


def _table(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(v) for kv in pairs.items() for v in kv])


def _first(rules: list[tuple[object, Column]], default: object) -> Column:
    """The value of the first rule that holds."""
    return reduce(lambda rest, rule: F.when(rule[1], rule[0]).otherwise(rest), reversed(rules), F.lit(default))


def _meets(items: Column, pattern: str) -> Column:
    return F.exists(items, lambda x: x.rlike(pattern))


def _any(x: Column, patterns: list[str]) -> Column:
    return x.rlike("|".join(patterns))


def base_name(path: _C) -> Column:
    return F.element_at(F.split(col(path), "/"), -1)


def extension(path: _C) -> Column:
    """With its dot, in lower case; empty if there is none."""
    return F.lower(F.regexp_extract(base_name(path), r"(\.[^.]*)$", 1))


def language(path: _C, use: str = "display") -> Column:
    """STR-15: by extension, for one of the uses of LANGUAGES."""
    table, other = LANGUAGES[use]
    return F.coalesce(F.try_element_at(_table(table), extension(path)), F.lit(other))


def module_first(path: _C) -> Column:
    """STR-14: the first folder, or root."""
    p = F.split(col(path), "/")
    return F.when(F.size(p) <= 1, F.lit("root")).otherwise(F.get(p, 0))


def module_second(path: _C) -> Column:
    """STR-14: the first folder, or the one below it where that is a usual root; a file straight in such a root, or in no folder, is in root."""
    p = F.split(col(path), "/")
    return F.when(F.size(p) <= 1, F.lit("root")).when(~F.get(p, 0).isin(MODULE_ROOTS), F.get(p, 0)).when(F.size(p) > 2, F.get(p, 1)).otherwise(F.lit("root"))


def module_last(path: _C) -> Column:
    """STR-14: the folder that holds the file."""
    p = F.split(col(path), "/")
    return F.when(F.size(p) <= 1, F.lit("root")).otherwise(F.get(p, F.size(p) - 2))


def module_dir(path: _C) -> Column:
    """STR-14: the whole folder path."""
    return F.when(F.contains(col(path), F.lit("/")), F.regexp_replace(col(path), r"/[^/]*$", "")).otherwise(F.lit("root"))


def module_of(path: _C, modules: _C) -> Column:
    """STR-14: the first of an array of module names that is a folder of the path, or null."""
    return F.get(F.filter(col(modules), lambda m: col(path).startswith(F.concat(m, F.lit("/"))) | F.contains(col(path), F.concat(F.lit("/"), m, F.lit("/")))), 0)


def skipped(path: _C) -> Column:
    """FLT-10: in a folder, of an extension, or of a name that the structure index leaves out."""
    low = F.lower(col(path))
    return F.arrays_overlap(F.split(low, "/"), F.array(*map(F.lit, SKIP_DIRS))) | extension(path).isin(SKIP_EXTENSIONS) | F.lower(base_name(path)).isin(SKIP_NAMES)


def skipped_analysis(path: _C) -> Column:
    """FLT-10: what the analysing index leaves out."""
    return F.arrays_overlap(F.split(col(path), "/"), F.array(*map(F.lit, SKIP_DIRS_ANALYSIS))) | extension(path).isin(SKIP_EXTENSIONS_ANALYSIS)


def skipped_document(path: _C) -> Column:
    """FLT-10: what the document reader leaves out: paths that start with a dot, and folders below the first level."""
    return col(path).startswith(".") | _any(col(path), [f"/{d.replace('.', r'[.]')}/" for d in SKIP_DIRS_DOCUMENTS])


def file_type(path: _C) -> Column:
    """STR-16, the structure index: config, test, doc, generated or source; the first rule that holds."""
    low, name, ext = F.lower(col(path)), F.lower(base_name(path)), extension(path)
    inside = lambda dirs: _any(low, [f"/{d}/" for d in dirs])
    rules = [
        ("config", name.isin(CONFIG_NAMES) | (name.startswith(".") & ~ext.isin(DOTTED_SOURCES))),
        ("test", inside(TEST_FOLDERS)),
        ("doc", inside(DOC_FOLDERS) | ext.isin(DOC_EXTENSIONS)),
        ("generated", inside(GENERATED_FOLDERS) | reduce(lambda a, b: a | b, [name.endswith(e) for e in GENERATED_ENDS])),
        ("config", ext.isin(CONFIG_EXTENSIONS)),
    ]
    return _first(rules, "source")


def file_type_analysis(path: _C) -> Column:
    """STR-16, the analysing index: test, generated, doc or source."""
    return _first([(kind, _any(F.lower(col(path)), patterns)) for kind, patterns in ANALYSIS_TYPES], "source")


def importance(path: _C) -> Column:
    """STR-17, the structure index: by type, name and place."""
    name, kind = F.lower(base_name(path)), file_type(path)
    score = _first([(n, kind == k) for k, n in IMPORTANCE_BY_TYPE.items()], IMPORTANCE_OTHER)
    for n, names in IMPORTANCE_BY_NAME.items():
        score = score + F.when(name.isin(names), n).otherwise(0)
    return score + F.when(F.lower(col(path)).startswith("src/"), IMPORTANCE_OF_SRC).otherwise(0)


def importance_analysis(path: _C, kind: _C | None = None) -> Column:
    """STR-17, the analysing index: points by patterns of the path and by type, within bounds."""
    low, kind = F.lower(col(path)), file_type_analysis(path) if kind is None else col(kind)
    points, pattern, word = ANALYSIS_INTERFACE
    score = F.lit(ANALYSIS_START) + F.when(low.rlike(pattern) & F.contains(low, F.lit(word)), points).otherwise(0) + F.when(kind == "test", ANALYSIS_TEST_POINTS).otherwise(0)
    for n, patterns in ANALYSIS_POINTS:
        score = score + F.when(_any(low, patterns), n).otherwise(0)
    score = F.coalesce(*[F.when(kind == k, n) for k, n in ANALYSIS_FIXED.items()], score)
    return F.greatest(F.lit(ANALYSIS_BOUNDS[0]), F.least(F.lit(ANALYSIS_BOUNDS[1]), score))


def is_entry_point(path: _C) -> Column:
    """STR-18, the structure index."""
    return F.lower(base_name(path)).isin(ENTRY_FILES)


def project_type(paths: _C) -> Column:
    """STR-19 over an array of paths, the analysing index: the first rule that any path meets, in lower case (Q-13)."""
    low = F.transform(col(paths), F.lower)
    return _first([(name, _meets(low, pattern)) for name, pattern in PROJECT_TYPES], PROJECT_OTHER)


def tech_stack(paths: _C) -> Column:
    """STR-19, the analysing index: every technology that any path points to, joined by slashes."""
    low = F.transform(col(paths), F.lower)
    found = F.concat_ws("/", *[F.when(_meets(low, pattern), F.lit(name)) for name, pattern in TECHNOLOGIES])
    return F.when(found == "", TECHNOLOGY_OTHER).otherwise(found)


def detected(path: _C) -> Column:
    """STR-19, the structure index: struct(project, technology) that a file's name, else its extension, points to, or null."""
    table = F.create_map(*[x for k, (p, t) in DETECTORS.items() for x in (F.lit(k), F.struct(F.lit(p).alias("project"), F.lit(t).alias("technology")))])
    return F.coalesce(F.try_element_at(table, F.lower(base_name(path))), F.try_element_at(table, extension(path)))


def repo_name(url: _C) -> Column:
    """STR-20: the last part of the path without .git."""
    return F.regexp_replace(F.regexp_extract(col(url), r"([^/]+?)/*$", 1), r"\.git$", "")


def repo_owner(url: _C) -> Column:
    """STR-20: the part before the last one."""
    return F.regexp_extract(col(url), r"^[a-z]+://[^/]+/(?:.*/)?([^/]+)/[^/]+/*$", 1)


def url_host(url: _C) -> Column:
    return F.lower(F.regexp_extract(col(url), r"^[a-zA-Z]+://([^/:?#]+)", 1))


def url_path(url: _C) -> Column:
    return F.regexp_extract(col(url), r"^[a-zA-Z]+://[^/?#]+([^?#]*)", 1)


def provider(url: _C) -> Column:
    """STR-20: by host."""
    h = url_host(url)
    return F.when(F.contains(h, F.lit("github")), "github").when(F.contains(h, F.lit("gitlab")), "gitlab").when(F.contains(h, F.lit("bitbucket")), "bitbucket").otherwise("local")


def provider_key(url: _C) -> Column:
    """STR-20: provider:owner/name in lower case."""
    return F.lower(F.concat(provider(url), F.lit(":"), repo_owner(url), F.lit("/"), repo_name(url)))


def file_url(repo_url: _C, kind: _C, branch: _C, path: _C) -> Column:
    """STR-32: where a host shows a file."""
    u, b, p = F.regexp_replace(col(repo_url), r"(\.git)?/*$", ""), col(branch), col(path)
    join = lambda mid: F.concat(u, F.lit(mid), b, F.lit("/"), p)
    return F.when(col(kind) == "github", join("/blob/")).when(col(kind) == "gitlab", join("/-/blob/")).when(col(kind) == "bitbucket", join("/src/")).otherwise(p)


def normal_url(url: _C) -> Column:
    """SRC-09: without slashes at the end and without .git."""
    return F.regexp_replace(F.regexp_replace(col(url), r"/+$", ""), r"(?i)\.git", "")


def owner_path(url: _C) -> Column:
    """SRC-09, STR-20: all of the path but its last part: with groups and subgroups for GitLab, the last folder for others."""
    path = F.regexp_replace(F.regexp_extract(normal_url(url), r"^[a-zA-Z]+://[^/]+/(.*)$", 1), r"^/+|/+$", "")
    parts = F.split(path, "/")
    return F.when(F.size(parts) < 2, F.lit("")).when(F.contains(F.lower(col(url)), F.lit("gitlab")), F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")).otherwise(F.get(parts, F.size(parts) - 2))


def raw_file_url(url: _C, branch: _C, path: _C) -> Column:
    """SRC-09: the address at which a host's interface gives one file. Fetching it is not part of the engine; a local folder is read by ``sources.files``."""
    kind, u = provider(url), normal_url(url)
    encoded = lambda x: F.replace(F.url_encode(x), F.lit("+"), F.lit("%20"))
    base = F.when(url_host(url) == "github.com", F.lit("https://api.github.com")).otherwise(F.concat(F.regexp_extract(u, r"^([a-zA-Z]+://[^/]+)", 1), F.lit("/api/v3")))
    name = repo_name(u)
    github = F.concat(base, F.lit("/repos/"), owner_path(url), F.lit("/"), name, F.lit("/contents/"), col(path))
    gitlab = F.concat(F.regexp_extract(u, r"^([a-zA-Z]+://[^/]+)", 1), F.lit("/api/v4/projects/"), encoded(F.concat(owner_path(url), F.lit("/"), name)), F.lit("/repository/files/"), encoded(col(path)), F.lit("/raw?ref="), encoded(col(branch)))
    bitbucket = F.concat(F.lit("https://api.bitbucket.org/2.0/repositories/"), owner_path(url), F.lit("/"), name, F.lit("/src/"), encoded(col(branch)), F.lit("/"), col(path))
    return F.when(kind == "github", github).when(kind == "gitlab", gitlab).when(kind == "bitbucket", bitbucket)
