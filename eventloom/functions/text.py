"""String, id, path, date and JSON expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Provenance of a tag -> (axis, role, authority, discoverable).
SOURCE_AXES = {
    "forced": ("forced", "discovery", 1.0, True),
    "user": ("user", "discovery", 1.0, True),
    "autotag": ("autotag", "qc", 0.4, False),
    "llm_build": ("llm_build", "qc", 0.4, False),
    "build": ("build", "baseline", 0.2, False),
    "working_folder": ("autotag", "container", 0.0, False),
}
# The display bucket of each role.
ROLE_BUCKETS = {"discovery": "forced", "qc": "autotag", "container": "container", "baseline": "build", "unknown": "unknown"}
# Texts that stand for no timestamp.
NO_TIMESTAMP = ["null", "none", "n/a", "na", "unknown", "undefined", ""]


def source_axis(source: Column, legacy: dict[str, str] | None = None) -> Column:
    """Struct (axis, role, authority, discoverable) of a tag's source; anything else is unknown.

    ``legacy`` gives older labels of a store and the label each stands for now.
    """
    for old, now in (legacy or {}).items():
        source = F.when(source == old, F.lit(now)).otherwise(source)
    out = F.struct(F.lit("unknown").alias("axis"), F.lit("unknown").alias("role"), F.lit(0.0).alias("authority"), F.lit(False).alias("discoverable"))
    for name, (axis, role, authority, seen) in SOURCE_AXES.items():
        out = F.when(source == name, F.struct(F.lit(axis).alias("axis"), F.lit(role).alias("role"), F.lit(authority).alias("authority"), F.lit(seen).alias("discoverable"))).otherwise(out)
    return out


def display_bucket(source: Column, legacy: dict[str, str] | None = None) -> Column:
    out = F.lit("unknown")
    for role, bucket in ROLE_BUCKETS.items():
        out = F.when(source_axis(source, legacy)["role"] == role, bucket).otherwise(out)
    return out


def normalise_name(name: Column, nfkc: bool = False) -> Column:
    """Trimmed, lower case, single spaces. ``nfkc`` adds the compatibility form by a pandas UDF on names beyond ASCII."""
    if nfkc:
        import unicodedata

        import pandas as pd

        @F.pandas_udf("string")
        def compose(s: pd.Series) -> pd.Series:
            return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))

        name = F.when(name.rlike(r"[^\x00-\x7F]"), compose(name)).otherwise(name)
    return F.lower(F.trim(F.regexp_replace(name, r"(?U)\s+", " ")))


# Fixed value: the pieces of a camelCase run.
CAMEL_PIECE = r"[A-Z]?[a-z0-9]+|[A-Z]+(?=[A-Z]|$)|\d+"


def grounding_tokens(text: Column) -> Column:
    """Distinct lower-case tokens: runs of letters and digits, those in ASCII cut where a camelCase word begins.

    A run of capitals counts up to the last one before a word or the end; an ASCII run with no such piece stays whole.
    """
    runs = F.regexp_extract_all(text, F.lit(r"(?U)[^\W_]+"), F.lit(0))
    pieces = lambda t: F.regexp_extract_all(t, F.lit(CAMEL_PIECE), F.lit(0))
    cut = F.transform(runs, lambda t: F.when(t.rlike(r"^[\x00-\x7F]+$") & (F.size(pieces(t)) > 0), pieces(t)).otherwise(F.array(t)))
    return F.array_distinct(F.transform(F.flatten(cut), F.lower))


def grounding_score(name: Column, text: Column) -> Column:
    """Share of a name's tokens that its text contains; 0 without tokens."""
    mine = grounding_tokens(name)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(mine, grounding_tokens(text))), F.size(mine)), F.lit(0.0))


def suspicious_name(name: Column) -> Column:
    return (F.length(name) > 100) | name.rlike(r"(?i)_and_\w+_and_\w+_and_\w+")


def extraction_issues(summary: Column, names: Column, text: Column | None = None, least_summary: int = 10, least_entities: int = 0, least_name: int = 1, least_text: int = 200) -> Column:
    """Array of the problems of an extraction result, in a fixed order; empty if there are none."""
    short = F.length(F.trim(F.coalesce(summary, F.lit(""))))
    bad = F.filter(names, lambda n: suspicious_name(F.trim(n)))
    rules = []
    if text is not None:
        size = F.length(F.trim(text))
        rules.append(F.when(size < least_text, F.concat(F.lit("input_too_short_"), size)))
    rules += [
        F.when(short == 0, F.lit("empty_summary")).when(short < least_summary, F.concat(F.lit("summary_too_short_"), short)),
        F.when((F.lit(least_entities) > 0) & (F.size(names) < least_entities), F.lit(f"entities_below_min_{least_entities}")),
        F.when((F.size(names) > 0) & F.forall(names, lambda n: F.length(F.trim(n)) <= least_name), F.lit("all_entities_too_short")),
        F.when(F.size(bad) > 0, F.concat(F.lit("suspicious_entity_pattern:"), F.substring(F.trim(F.get(bad, F.lit(0))), 1, 60))),
    ]
    return F.array_compact(F.array(*rules))


def locator(path: Column, section: Column, segment: Column, slide: Column, page: Column) -> Column:
    """``path::sect=…,seg=N,slide=N,page=N`` of the parts that are there."""
    part = lambda key, c: F.when(c.isNotNull(), F.concat(F.lit(key + "="), c.cast("string")))
    rest = F.concat_ws(",", part("sect", section), part("seg", segment), part("slide", slide), part("page", page))
    return F.when(rest != "", F.concat_ws("::", path, rest)).otherwise(path)


def event_id(domain: Column, folder: Column, content: Column) -> Column:
    return F.concat(F.lit("evt_"), F.substring(F.sha2(F.concat_ws(":", domain, F.coalesce(folder, F.lit("")), content), 256), 1, 32))


def prefixed_id(prefix: str, *parts: Column) -> Column:
    """A stable id; the same parts give the same one."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 32))


def path_id(path: Column, root: str, domain: str, is_dir: bool = False) -> Column:
    """Canonical id of a path below ``root``: slashes, lower case, relative, ``domain::path/`` in front. Outside: null."""
    posix = F.regexp_replace(path, r"\\", "/")
    base = root.replace("\\", "/").rstrip("/")
    absolute = posix.startswith("/") | posix.rlike("^[A-Za-z]:/")
    inside = posix.startswith(base + "/")
    rel = F.when(~absolute, F.regexp_replace(posix, r"^(\./)+", "")).when(inside, posix.substr(F.lit(len(base) + 2), F.length(posix)))
    rel = F.regexp_replace(F.regexp_replace(F.lower(rel), "/+", "/"), "^/", "")
    return F.concat(F.lit(f"{domain.lower()}::path/"), F.when(F.lit(is_dir) & ~rel.endswith("/"), F.concat(rel, F.lit("/"))).otherwise(rel))


def path_ancestors(leaf: Column) -> Column:
    """``d::path/a/b.py`` -> [``d::path/a/``, ``d::path/a/b.py``]: every folder above the leaf, then the leaf."""
    head = F.regexp_extract(leaf, r"^(.*?::[^/]*/)", 1)
    rest = leaf.substr(F.length(head) + 1, F.length(leaf))
    parts = F.filter(F.split(rest, "/"), lambda p: p != "")
    n = F.size(parts)
    folders = F.transform(F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.expr("cast(array() as array<int>)")), lambda k: F.concat(head, F.concat_ws("/", F.slice(parts, F.lit(1), k)), F.lit("/")))
    return F.concat(folders, F.array(leaf))


def normalise_timestamp(text: Column) -> Column:
    """ISO text of a full date or date and time in one of the known forms; null for partial dates and other text."""
    t = F.trim(text)
    dash = F.regexp_replace(t, r"^(\d{4})[/.](\d{2})[/.](\d{2})", "$1-$2-$3")
    compact = F.regexp_replace(dash, r"^(\d{4})(\d{2})(\d{2})(?=$|[T_ -])", "$1-$2-$3")
    time = F.regexp_replace(compact, r"^(\d{4}-\d{2}-\d{2})[-_ T](\d{2}):?(\d{2}):?(\d{2})", "$1T$2:$3:$4")
    dated = F.regexp_replace(F.regexp_replace(time, r"^(\d{4}-\d{2}-\d{2}) (\d{2}:\d{2})$", "$1T$2"), r"^(\d{4}-\d{2}-\d{2})[-_ T](\d{2})-(\d{2})-(\d{2})", "$1T$2:$3:$4")
    whole = dated.rlike(r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})?)?$")
    sound = F.try_to_timestamp(F.substring(dated, 1, 10), F.lit("yyyy-MM-dd")).isNotNull()
    return F.when(F.lower(t).isin(NO_TIMESTAMP), None).when(whole & sound, F.regexp_replace(dated, "Z$", "+00:00"))


def json_cascade(field: str, *sources: Column) -> Column:
    """First of the JSON texts that has ``field``: domain settings before global ones before defaults."""
    return F.coalesce(*(F.get_json_object(s, f"$.{field}") for s in sources))


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def strength(kind: str, value: Column) -> Column:
    strong, medium = (5, 1) if kind == "entity" else (0.4, 0.2)
    return F.when(value >= strong, "strong").when(value > medium if kind == "entity" else value >= medium, "medium").otherwise("weak")


def token_set(a: Column) -> Column:
    """Sorted distinct words of a name, as ``token_set_ratio`` takes them."""
    import pandas as pd

    @F.pandas_udf("array<string>")
    def words(x: pd.Series) -> pd.Series:
        return x.map(lambda p: sorted(set((p or "").lower().split())))

    return words(a)


def token_set_ratio(a: Column, b: Column) -> Column:
    """Similarity (0 to 1) of two names whatever the order and repetition of their words, by an Arrow-batched UDF."""
    from difflib import SequenceMatcher

    import pandas as pd

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        def one(p, q):
            p, q = set((p or "").lower().split()), set((q or "").lower().split())
            if not p or not q:
                return 0.0
            both = " ".join(sorted(p & q))
            left, right = " ".join(filter(None, [both, " ".join(sorted(p - q))])), " ".join(filter(None, [both, " ".join(sorted(q - p))]))
            pairs = [(left, right)] + ([(both, left), (both, right)] if both else [])
            return max(SequenceMatcher(None, u, v, False).ratio() for u, v in pairs)

        return pd.Series([one(p, q) for p, q in zip(x, y, strict=True)])

    return ratio(a, b)
