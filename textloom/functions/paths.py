"""Path functions: Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Directories of version control, of third parties and of demonstrations (fixed values).
VCS = (".git", ".hg", ".svn", ".bzr")
VENDORED = ("vendor", "third_party", "thirdparty", "node_modules", "external", "deps")
DEMO = ("examples", "example", "demo", "demos", "samples", "sample")
#: Language by extension, files of build and configuration, languages that count as code.
LANGUAGES = {
    "py": "Python", "pyi": "Python", "js": "JavaScript", "jsx": "JavaScript", "mjs": "JavaScript", "ts": "TypeScript", "tsx": "TypeScript", "go": "Go", "rs": "Rust",
    "java": "Java", "kt": "Kotlin", "rb": "Ruby", "php": "PHP", "c": "C", "h": "C", "cpp": "C++", "cc": "C++", "hpp": "C++", "cs": "C#", "scala": "Scala", "sh": "Shell",
    "sql": "SQL", "yaml": "YAML", "yml": "YAML", "toml": "TOML", "json": "JSON", "md": "Markdown", "rst": "reStructuredText", "proto": "Protobuf",
    "csproj": "MSBuild", "fsproj": "MSBuild", "vbproj": "MSBuild", "sln": "MSBuild", "props": "MSBuild", "targets": "MSBuild",
}
BUILD_FILES = (
    "pyproject.toml", "setup.py", "setup.cfg", "requirements.txt", "Pipfile", "package.json", "go.mod", "Cargo.toml", "pom.xml", "build.gradle", "Dockerfile",
    "docker-compose.yml", "docker-compose.yaml", "Makefile", ".gitlab-ci.yml", "Gemfile", "composer.json",
)
CODE = ("Python", "JavaScript", "TypeScript", "Go", "Rust", "Java", "Kotlin", "Ruby", "PHP", "C", "C++", "C#", "Scala")
#: Names of files that hold secrets, as globs over lower-case names.
SECRET_GLOBS = (
    ".env", ".env.*", "*.pem", "*.key", "*.pfx", "*.p12", "*.pkcs12", "*.der", "id_rsa", "id_dsa", "id_ecdsa", "id_ed25519", "*.keystore", "*.jks",
    ".npmrc", ".pypirc", ".netrc", "credentials", "*.pgpass", "*_rsa", "*_ed25519",
)


def parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda p: p != "")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def directories(path: Column) -> Column:
    p = parts(path)
    return F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0)))


def in_directory(path: Column, names: tuple[str, ...]) -> Column:
    """Whether one of the path's directories (of the given spelling) has one of the names; a pattern, as arrays would be built for every row."""
    return path.rlike(r"(?:^|/)(?:" + "|".join(n.replace(".", r"\.") for n in names) + ")/+[^/]")


def is_vcs(path: Column) -> Column:
    return F.arrays_overlap(parts(path), F.array(*map(F.lit, VCS)))


def is_vendored(path: Column) -> Column:
    return in_directory(F.lower(path), VENDORED)


def is_demo(path: Column) -> Column:
    return in_directory(F.lower(path), DEMO)


def is_test(path: Column) -> Column:
    low = F.lower(path)
    return in_directory(low, ("test", "tests", "testing", "spec", "__tests__")) | basename(low).rlike(r"^test_|_test\.|\.test\.|\.spec\.|^conftest\.")


def is_secret(path: Column) -> Column:
    """Files that are never shown, by their names in any case."""
    forms = "|".join(g.replace(".", r"\.").replace("*", ".*") for g in SECRET_GLOBS)
    return F.lower(basename(path)).rlike(rf"(?s)\A(?:{forms})\z")


def path_rank(path: Column) -> list[Column]:
    """Own library code first: order by (vendored, demonstration, path)."""
    return [is_vendored(path).cast("int"), is_demo(path).cast("int"), path]


def component_for(path: Column, depth: int = 2) -> Column:
    """The component of a file: its first ``depth`` directories, without a leading src; ``(root)`` at the top."""
    d = directories(path)
    inner = F.when((F.size(d) > 1) & (F.get(d, 0) == "src"), F.slice(d, 2, depth)).otherwise(F.slice(d, 1, depth))
    return F.when(F.size(d) == 0, F.lit("(root)")).otherwise(F.array_join(inner, "/"))


def module_name(path: Column) -> Column:
    """Dotted module of a Python file."""
    bare = F.regexp_replace(F.regexp_replace(path, r"\.py$", ""), r"/__init__$", "")
    return F.replace(F.regexp_replace(bare, r"^src/", ""), F.lit("/"), F.lit("."))


def rust_module_name(path: Column) -> Column:
    """Module of a Rust file below its crate's directory (``crate`` at the top), null for other files."""
    p = parts(path)
    at = F.array_position(p, "src").cast("int")
    above = F.when(at > 1, F.array_join(F.slice(p, F.lit(1), F.greatest(at - 1, F.lit(0))), "::")).otherwise("crate")
    inside = F.slice(p, at + 1, F.size(p))
    stem = F.regexp_replace(F.element_at(p, -1), r"\.rs$", "")
    names = F.concat(F.array(above), F.slice(inside, F.lit(1), F.greatest(F.size(inside) - 1, F.lit(0))), F.when(stem.isin("lib", "main", "mod"), F.array().cast("array<string>")).otherwise(F.array(stem)))
    return F.when(path.endswith(".rs"), F.array_join(names, "::"))


def safe_name(name: Column) -> Column:
    """A name of ASCII letters, digits and single underscores; ``component`` if nothing is left."""
    cleaned = F.regexp_replace(F.regexp_replace(name, "[^A-Za-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(cleaned == "", "component").otherwise(cleaned)


def detect_language(path: Column, head: Column | None = None) -> Column:
    """Language by file name, extension, and for headers by content."""
    name = basename(path)
    ext = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    known = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))
    by_ext = F.coalesce(F.element_at(known, ext), F.lit("Other"))
    if head is not None:
        bare = F.regexp_replace(head, r"""(?s)//[^\n]*+|/\*.*?\*/|"[^"\\]*+(?:\\.[^"\\]*+)*+"|'[^'\\]*+(?:\\.[^'\\]*+)*+'""", " ")
        by_ext = F.when((ext == "h") & bare.rlike(r"\b(?:class|template|namespace)\b"), F.lit("C++")).otherwise(by_ext)
    return F.when(name.isin(*BUILD_FILES), F.lit("Build")).otherwise(by_ext)


def is_code(language: Column) -> Column:
    return language.isin(*CODE)


def glob_regex(globs: list[str]) -> str:
    """One regular expression for ignore globs: matched on the whole path, a directory glob also beneath it."""
    import re

    out = []
    for g in globs:
        for form in {g, g.removeprefix("**/")}:
            body = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in form.removesuffix("/*").rstrip("/"))
            out.append(f"{body}(?:/.*)?")
    return "^(?:" + "|".join(out) + ")$" if out else "(?!)"


#: Endings of generated C# files; headers of the C standard library.
GENERATED_CSHARP = (".designer.cs", ".g.cs", ".g.i.cs", ".generated.cs", "assemblyinfo.cs")
STANDARD_HEADERS = (
    "assert.h", "complex.h", "ctype.h", "errno.h", "fenv.h", "float.h", "inttypes.h",
    "iso646.h", "limits.h", "locale.h", "math.h", "setjmp.h", "signal.h", "stdalign.h",
    "stdarg.h", "stdatomic.h", "stdbool.h", "stddef.h", "stdint.h", "stdio.h",
    "stdlib.h", "stdnoreturn.h", "string.h", "tgmath.h", "threads.h", "time.h",
    "uchar.h", "wchar.h", "wctype.h",
)


def is_generated_csharp(path: Column) -> Column:
    """C# files that tools wrote."""
    return F.lower(path).rlike("(?:" + "|".join(e.replace(".", r"\.") for e in GENERATED_CSHARP) + ")$")


def is_system_header(name: Column) -> Column:
    """Headers of the C library by file name, and those of C++, which have no ending and no directory."""
    return basename(name).isin(*STANDARD_HEADERS) | ~name.rlike("[/.]")
