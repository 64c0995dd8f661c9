"""Which paths are searched at all: predicates over paths and metadata, and the audit of what they exclude."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ascii_lower

# Names that the policy excludes.
PRUNED_DIRS = ("node_modules target dist build coverage .venv venv __pycache__ .next out vendor .terraform .gradle .dart_tool .mypy_cache .pytest_cache .ruff_cache .tox .turbo .parcel-cache .nuxt .svelte-kit .build pods deriveddata").split()
PRUNED_FILES = ("package-lock.json pnpm-lock.yaml yarn.lock bun.lock bun.lockb cargo.lock poetry.lock pdm.lock uv.lock pipfile.lock composer.lock gemfile.lock podfile.lock pubspec.lock").split()
BINARY = ("7z a avif bin bmp bz2 class db dll dylib eot exe flac gif gz heic heif ico jar jpeg jpg m4a mkv mov mp3 mp4 o obj ogg otf parquet pdf pdb pkl png pyc rar so sqlite sqlite3 tar tgz ttf wav wasm webm webp woff woff2 xz zip").split()
DENIED_PARTS = (".git .hg .svn .codex .claude .agents .agent .gemini .ssh .aws .azure .kube .docker .gnupg .direnv .password-store").split()
DENIED_NAMES = (".npmrc .pypirc .netrc .git-credentials id_rsa id_ed25519 id_dsa id_ecdsa .envrc .secrets secrets.json secrets.yaml secrets.yml secrets.toml credentials credentials.toml application_default_credentials.json service-account.json service_account.json kubeconfig").split()
DENIED_ENDS = ".pem .key .p12 .pfx .jks .keystore .tfstate".split()
ENV_SAMPLES = ".env.example .env.sample .env.template .env.defaults".split()
MAX_FILE_BYTES = 2 * 1024 * 1024


def _parts(path: Column) -> tuple[Column, Column]:
    parts = F.filter(F.split(ascii_lower(path), "/"), lambda p: ~p.isin("", "."))
    return parts, F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))


def is_denied(path: Column) -> Column:
    """Paths that may hold secrets or belong to version control or agents; an empty path too."""
    parts, name = _parts(path)
    ends = F.lit(False)
    for e in DENIED_ENDS:
        ends = ends | F.endswith(name, F.lit(e))
    env = ((name == ".env") | F.startswith(name, F.lit(".env."))) & ~name.isin(ENV_SAMPLES)
    inside = F.concat(F.lit("/"), F.array_join(parts, "/"), F.lit("/"))
    return (name == "") | F.exists(parts, lambda p: p.isin(DENIED_PARTS)) | F.contains(inside, F.lit("/.config/gcloud/")) | name.isin(DENIED_NAMES) | ends | F.contains(name, F.lit(".tfstate.")) | env


def is_pruned(path: Column) -> Column:
    """Build output, dependencies, and lock files."""
    parts, name = _parts(path)
    return F.exists(parts, lambda p: p.isin(PRUNED_DIRS) | F.startswith(p, F.lit("cmake-build-"))) | name.isin(PRUNED_FILES)


def extension(path: Column) -> Column:
    """The lower-cased extension; "" for none and for names that only start with a dot."""
    return ascii_lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))


def is_binary(path: Column) -> Column:
    return extension(path).isin(BINARY)


def excluded_by_metadata(length: Column, links: Column | None = None) -> Column:
    return (length > MAX_FILE_BYTES) | (F.lit(False) if links is None else links > 1)


def normalize_path(path: Column) -> Column:
    """The relative path without "." parts; null where it is absolute, empty, or holds ".." or controls."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    bad = F.startswith(path, F.lit("/")) | F.array_contains(parts, "..") | F.rlike(path, F.lit(r"[\x00-\x1F\x7F]")) | (F.size(parts) == 0)
    return F.when(~bad, F.array_join(parts, "/"))


def with_reason(files: DataFrame, path: str = "path", length: str | None = None, links: str | None = None) -> DataFrame:
    """files with `reason`: the first policy that excludes the file, or null if it may be searched."""
    p = F.col(path)
    out = F.when(is_denied(p), "denied").when(is_pruned(p), "pruned").when(is_binary(p), "binary")
    if length:
        out = out.when(excluded_by_metadata(F.col(length), F.col(links) if links else None), "metadata")
    return files.withColumn("reason", out)


def language(path: Column) -> Column:
    """The syntax that a path's extension names; null for others."""
    e = extension(path)
    out = F.when(e == "rs", "rust").when(e.isin("py", "pyi"), "python").when(e.isin("js", "jsx", "mjs", "cjs"), "javascript")
    return out.when(e.isin("ts", "mts", "cts"), "typescript").when(e == "tsx", "tsx").when(e == "go", "go")


#: Reasons that leave the scan complete: exclusions by policy, and files that are no text.
HARMLESS = ("denied", "pruned", "binary", "metadata", "ignore_file", "not_regular", "non_utf8", "cancelled")


def makes_incomplete(reason: Column) -> Column:
    """Whether a file that should have been searched couldn't be read."""
    return reason.isNotNull() & ~reason.isin(*HARMLESS)
