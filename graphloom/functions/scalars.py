"""Scalar functions of names, paths, spans and scores, as Column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def levenshtein_similarity(a: Column, b: Column, by_bytes: bool = False) -> Column:
    """1 - distance / longer length, in characters (or bytes); 1 for two empty strings."""
    size = F.octet_length if by_bytes else F.length
    longer = F.greatest(size(a), size(b))
    return F.when(longer == 0, 1.0).otherwise(1.0 - F.levenshtein(a, b) / longer)


def trigrams(col: Column) -> Column:
    """Distinct trigrams; the whole string where it is shorter than 3."""
    return F.when(F.length(col) < 3, F.array(col)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(col) - 2)), lambda i: F.substr(col, i, F.lit(3)))))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def normalise(col: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(col), r"\s+", " "))


def name_relevance(name: Column, qualified: Column, query: str) -> Column:
    q, n = query.lower(), F.lower(name)
    return F.when(n == q, 1.0).when(n.startswith(q), 0.9).when(n.contains(q), 0.7).when(F.lower(qualified).contains(q), 0.5).otherwise(0.3)


def token_estimate(text: Column) -> Column:
    """ceil(ceil(bytes / 4) * 6 / 5), 1 at least."""
    return F.greatest(F.lit(1).cast("long"), F.ceil(F.ceil(F.octet_length(text) / 4) * 6 / 5))


def directory(path: Column, depth: int) -> Column:
    return F.array_join(F.slice(F.split(path, "/"), 1, depth), "/")


def simple_name(col: Column) -> Column:
    return F.regexp_extract(col, r"([^:./]*)$", 1)


def url_path(col: Column) -> Column:
    """Without query string, doubled or closing slashes; {id}, <int:id> and [id] become :id."""
    bare = F.regexp_replace(F.regexp_replace(col, r"[?#].*$", ""), "/+", "/")
    bare = F.regexp_replace(bare, "(.)/$", "$1")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, r"\{([^}]*)\}", ":$1"), r"<(?:[^:>]*:)?([^>]*)>", ":$1"), r"\[([^\]]*)\]", ":$1")


def relative_path(path: Column, root: str) -> Column:
    """The path below ``root``; others stay as they are."""
    return F.when(path.startswith(f"{root}/"), F.substr(path, F.lit(len(root) + 2))).otherwise(path)


def redact(df, rules: dict[str, str]):
    """Columns hidden, hashed, or without their numbers, as rules name them; other columns stay."""
    how = {"hide": lambda c: F.lit(f"[{c}]"), "hash": F.md5, "numbers": lambda c: F.regexp_replace(c, "[0-9]+", "[number]")}
    return df.withColumns({c: how[r](c) for c, r in rules.items()})


def sort_fields(first: str) -> list[str]:
    """A sort field with the fixed order of the others after it."""
    ties = {"file": ["path", "start_line", "name", "kind"], "line": ["start_line", "path", "name", "kind"], "name": ["name", "path", "start_line", "kind"], "kind": ["kind", "name", "path", "start_line"]}
    return [*ties[first], "id"]


def query_kind(q: Column) -> Column:
    """semantic, text or hybrid, by the marks that a query text has."""
    semantic = r"(callers|callees|imports|exports|returns)[(:]|(impl|duplicates|unused|circular|kind|visibility|async|static):|scope\.|@|::"
    text = r"TODO|FIXME|HACK|XXX|NOTE|BUG|^\^|\$\z|\\[bwdsWDS]|//|^#|/\*"
    return F.when(q.rlike(semantic), "semantic").when(q.rlike(text), "text").otherwise("hybrid")


def text_rank(line: Column, found: Column, number: Column, path: Column, depth: Column) -> Column:
    """Rank of a lower-cased line with ``found`` matches: repeats, comments, code files, place and depth."""
    more = F.when(found > 1, 2 * found).otherwise(0)
    comment = F.when(F.ltrim(line).rlike(r"^(//|/\*|#)"), 1).otherwise(0)
    code = F.when(path.rlike(r"(?i)\.(rs|py|ts|js)$"), 1).otherwise(0)
    place = (1000 - F.least(number, F.lit(1000))) / 1000 * 2
    deep = F.when(depth > 3, (depth - 3) * 0.5).otherwise(0)
    return F.greatest(F.lit(0), 5 + more - comment + code + place - deep)


def page(rows, cursor: str | None, size: int):
    """The rows from a cursor (base64url of offset:N) on, and the next page's cursor."""
    from base64 import urlsafe_b64decode, urlsafe_b64encode

    start = 0
    if cursor:
        name, _, n = urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)).decode().partition(":")
        if name != "offset" or not n.isdigit():
            raise ValueError(f"bad cursor {cursor!r}")
        start = int(n)
    return rows.offset(start).limit(size), urlsafe_b64encode(f"offset:{start + size}".encode()).decode().rstrip("=")


def week_range(week: Column) -> list[Column]:
    """The first and last day of an ISO week such as 2024-W07."""
    year, n = F.split_part(week, F.lit("-W"), F.lit(1)).cast("int"), F.split_part(week, F.lit("-W"), F.lit(2)).cast("int")
    monday = F.date_add(F.trunc(F.make_date(year, F.lit(1), F.lit(4)), "week"), (n - 1) * 7)
    return [monday.cast("string").alias("first_day"), F.date_add(monday, 6).cast("string").alias("last_day")]


def jni_name(package: Column, method: Column) -> Column:
    mangled = F.regexp_replace(F.regexp_replace(package, "_", "_1"), r"\.", "_")
    return F.concat(F.lit("Java_"), mangled, F.lit("_"), F.regexp_replace(method, "_", "_1"))


def csv_guard(col: Column) -> Column:
    """A leading quote before what a spreadsheet would run as a formula."""
    return F.when(col.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), col)).otherwise(col)


def edge_confidence(kind: Column, is_async: Column, is_wildcard: Column | None = None) -> Column:
    wild = F.lit(False) if is_wildcard is None else F.coalesce(is_wildcard, F.lit(False))
    return F.when(kind == "calls", F.when(is_async, 0.9).otherwise(1.0)).when(kind == "imports", F.when(wild, 0.7).otherwise(0.95)).when(kind == "references", 0.8).when(kind.isin("inherits", "implements"), 0.95).otherwise(1.0)


#: The edge kinds of each class.
CLASSES = {
    "call": ("calls", "trait_method_binding", "ffi_call", "http_request", "grpc_call", "web_assembly_call"),
    "import": ("imports", "module_requires", "module_provides"),
    "export": ("exports", "module_exports", "module_opens"),
    "reference": ("references", "annotated_with", "annotation_param", "lambda_captures", "extension_receiver", "macro_expansion", "lifetime_constraint", "wraps"),
    "inherits": ("inherits", "sealed_permit"),
    "implements": ("implements",),
    "contains": ("contains", "companion_of"),
    "defines": ("defines",),
    "type_of": ("type_of", "generic_bound", "type_argument"),
    "database_access": ("db_query", "table_read", "table_write", "triggered_by"),
    "service_interaction": ("message_queue", "web_socket", "graphql_operation", "process_exec", "file_ipc", "protocol_call"),
}


def edge_class(kind: Column) -> Column:
    out = kind
    for name, kinds in CLASSES.items():
        out = F.when(kind.isin(*kinds), name).otherwise(out)
    return out


def _jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used, left = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                left.append(c)
                break
    m = len(left)
    if not m:
        return 0.0
    right = [c for c, u in zip(b, used, strict=True) if u]
    t = sum(x != y for x, y in zip(left, right, strict=True)) / 2
    return (m / len(a) + m / len(b) + (m - t) / m) / 3


def _winkler(a: str, b: str) -> float:
    j, same = _jaro(a, b), 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        same += 1
    return j + same * 0.1 * (1 - j) if j > 0.7 else j


def jaro_winkler(a: Column, b: Column) -> Column:
    """Jaro-Winkler similarity, which Spark lacks, in Arrow batches."""

    def score(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([_winkler(p or "", q or "") for p, q in zip(x, y, strict=True)])

    return F.pandas_udf(score, "double", F.PandasUDFType.SCALAR)(a, b)
