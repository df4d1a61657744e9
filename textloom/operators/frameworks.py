"""Test frameworks of repositories, by what their files show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as px

# Directories that are not looked into, and what counts as evidence.
PRUNED = (".git", ".svn", ".hg", "node_modules", ".venv", "venv", "__pycache__", "build", "dist", "target", ".mypy_cache", ".pytest_cache", ".tox")
GTEST_DIRECTORIES = ("googletest", "gtest", "gmock", "googlemock")
BUILD_FILES = ("cmakelists.txt", "makefile", "gnumakefile")
GTEST_BUILD = r"(?i)googletest|gtest|gmock|GTest::"
UNITY_BUILD = r"(?i)unity\.[ch]\b|ThrowTheSwitch"
UNITY_FILES = ("unity.c", "unity.h")
PYTEST_FILES = ("pyproject.toml", "setup.cfg")
PYTEST = r"(?i)\bpytest\b"
ASSERT_INCLUDE = r'(?m)^\s*#\s*include\s*[<"](?:cassert|assert\.h)[>"]'
MAIN = r"(?m)^\s*(?:int|void)\s+main\s*\("
ANY_FRAMEWORK = r"(?i)gtest|gmock|unity\.h|catch2?/|doctest"
TEST_NAME = r"(?i)(?:^|[-_])tests?(?:[-_.]|$)|^tests?[-_]"
PACKAGE = r'(?i)<PackageReference\s+Include="([^"]+)"'
C_ENDINGS = ("c",)
CPP_ENDINGS = ("cpp", "cc", "cxx", "c")
NO_FRAMEWORK = "plain assert()/main()"
CSHARP = (("xunit", "xUnit"), ("nunit", "NUnit"), ("mstest", "MSTest"))


def _package_framework(text: Column) -> Column:
    """The framework that a C# project refers to, null if none."""
    packages = F.transform(F.regexp_extract_all(text, F.lit(PACKAGE), F.lit(1)), F.lower)

    def has(start: str) -> Column:
        return F.exists(packages, lambda p: p.startswith(start))

    return F.coalesce(*(F.when(has(start), name) for start, name in CSHARP))


def frameworks(files: DataFrame, repo: str, defaults: dict[str, str]) -> DataFrame:
    """Per repository and language of ``defaults``: ``language, framework, detected``.

    ``files`` has ``path`` and ``text`` (null: empty) beside ``repo``. Each file is
    looked at once, where it is read; what is shuffled are flags, added up in
    each task. Of C# projects with evidence the first path counts. Without
    evidence the default stands, and ``detected`` is false. Build files are read
    whole; repeated rows change nothing, and a null repository is one of its own.
    """
    path, text = F.col("path"), F.coalesce("text", F.lit(""))
    base = px.basename(path)
    name, open_ = F.lower(base), ~px.in_directory(path, PRUNED)
    built = open_ & name.isin(*BUILD_FILES)
    plain = open_ & F.regexp_replace(base, r"\.[^.]*$", "").rlike(TEST_NAME) & text.rlike(ASSERT_INCLUDE) & text.rlike(MAIN) & ~text.rlike(ANY_FRAMEWORK)
    ending = F.regexp_extract(name, r"\.([^.]*)$", 1)
    flags = {
        "gtest": open_ & F.arrays_overlap(F.transform(px.directories(path), F.lower), F.array(*map(F.lit, GTEST_DIRECTORIES))) | built & text.rlike(GTEST_BUILD),
        "unity": open_ & name.isin(*UNITY_FILES) | built & text.rlike(UNITY_BUILD),
        "plain_c": plain & ending.isin(*C_ENDINGS),
        "plain_cpp": plain & ending.isin(*CPP_ENDINGS),
        "pytest": (base == "conftest.py") | open_ & (name.isin(*PYTEST_FILES) | name.startswith("requirements") & name.endswith(".txt")) & text.rlike(PYTEST),
        "cargo": base == "Cargo.toml",
    }
    seen = files.select(F.col(repo).alias("repo"), "path", *(c.alias(n) for n, c in flags.items()), F.when(path.endswith(".csproj"), _package_framework(text)).alias("package"))
    found = seen.groupBy("repo").agg(*(F.coalesce(F.bool_or(n), F.lit(False)).alias(n) for n in flags), F.min_by("package", F.when(F.col("package").isNotNull(), F.col("path"))).alias("package"))
    evidence = {
        "C": F.when(F.col("unity"), "Unity").when(F.col("plain_c"), NO_FRAMEWORK),
        "C++": F.when(F.col("gtest"), "GoogleTest").when(F.col("plain_cpp"), NO_FRAMEWORK),
        "Python": F.when(F.col("pytest"), "pytest"),
        "Rust": F.when(F.col("cargo"), "cargo test"),
        "C#": F.col("package"),
    }
    rows = F.array(*(F.struct(F.lit(language).alias("language"), evidence.get(language, F.lit(None).cast("string")).alias("f"), F.lit(default).alias("d")) for language, default in defaults.items()))
    return found.select(F.col("repo").alias(repo), F.explode(rows).alias("r")).select(repo, "r.language", F.coalesce("r.f", "r.d").alias("framework"), F.col("r.f").isNotNull().alias("detected"))
