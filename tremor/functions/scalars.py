"""Paths, names, ids, scores and text rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Strategy weights by profile.
PROFILES: dict[str, dict[str, float]] = {
    "conservative": {"direct": 0.95, "transitive": 0.55, "coverage": 0.85, "imports": 0.4, "confidence_weight": 0.35, "line_boost_max": 0.15},
    "balanced": {"direct": 0.95, "transitive": 0.7, "coverage": 0.8, "imports": 0.5, "confidence_weight": 0.3, "line_boost_max": 0.2},
    "aggressive": {"direct": 0.95, "transitive": 0.82, "coverage": 0.9, "imports": 0.65, "confidence_weight": 0.25, "line_boost_max": 0.25},
}
# Score bands, consensus bonus, defaults.
HIGH, MEDIUM = 0.8, 0.5
CONSENSUS = 0.05
DEFAULT_CONFIDENCE = 0.6
# An error text's category, first hit wins.
ERROR_RULES = (("Failed to set up repository", "Repository Setup"), ("Execution failed", "Execution Failed"))


def profile(name: str | None) -> dict[str, float]:
    """Weights of a profile; none means balanced, unknown names raise."""
    key = (name or "balanced").strip().lower()
    if key not in PROFILES:
        raise ValueError(f"unknown strategy {name!r}; known: {', '.join(PROFILES)}")
    return PROFILES[key]


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


# -- paths and names ---------------------------------------------------------


def slashes(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def module_name(path: Column) -> Column:
    """Dotted module of a path: suffix .py off, separators to dots, outer dots off."""
    return F.regexp_replace(F.translate(F.regexp_replace(path, r"\.py$", ""), "\\/", ".."), r"^\.+|\.+$", "")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def directories(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))


def dotted_suffixes(name: Column, proper: bool = True) -> Column:
    """a.b.c -> [b.c, c], with the whole name first unless proper."""
    parts = F.split(name, r"\.")
    n = F.size(parts)
    first = 2 if proper else 1
    places = F.when(n >= first, F.sequence(F.lit(first), n)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.array_join(F.slice(parts, i, n), "."))


def last_part(name: Column, sep: str = r"\.") -> Column:
    return F.element_at(F.split(name, sep), -1)


def normalise_paths(path: Column, root: Column | str) -> Column:
    """Path relative to root with forward slashes; null for paths outside it and for other suffixes than .py."""
    root = F.regexp_replace(F.lit(root) if isinstance(root, str) else root, "/+$", "")
    p = slashes(path)
    inside = F.when(p.startswith("/"), F.when(F.startswith(p, F.concat(root, F.lit("/"))), F.substr(p, F.length(root) + 2))).otherwise(F.regexp_replace(p, r"^[./]+", ""))
    return F.when(inside.endswith(".py"), inside)


def glob_to_regex(pattern: str) -> str:
    """A shell pattern as a regular expression that must match all of a name."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "[" and (end := pattern.find("]", i + 2)) > 0:
            body = pattern[i + 1 : end]
            out.append("[" + ("^" + body[1:] if body[0] == "!" else body).replace("\\", r"\\") + "]")
            i = end
        else:
            out.append({"*": ".*", "?": "."}.get(c) or ("\\" + c if not (c.isalnum() or c in "_/") else c))
        i += 1
    return f"(?s)^{''.join(out)}$"


def matches_any(name: Column, patterns: list[str]) -> Column:
    return F.coalesce(F.rlike(name, F.lit("|".join(map(glob_to_regex, patterns)))), F.lit(False)) if patterns else F.lit(False)


def is_test_path(path: Column) -> Column:
    """A test file by name, or any file below a directory named test or tests."""
    return F.rlike(base_name(path), F.lit(r"^test_.*\.py$|_test\.py$|^tests\.py$")) | F.arrays_overlap(directories(path), F.array(F.lit("test"), F.lit("tests")))


def normalise_node_id(node_id: Column) -> Column:
    """Backslashes to slashes, cut at the first pipe, parameters in brackets off."""
    return F.regexp_replace(F.element_at(F.split(slashes(F.trim(node_id)), r"\|"), 1), r"\[.*\]", "")


def pytest_node_id(test_file: Column, test_name: Column, full_name: Column, test_id: Column) -> Column:
    """file::name, else the full name, else taken from an id ``test::file::name:line``."""
    named = F.when((F.length(F.trim(test_file)) > 0) & (F.length(F.trim(test_name)) > 0), F.concat_ws("::", test_file, test_name))
    inner = F.regexp_extract(test_id, r"^test::(.+?)::(.+?)(?::\d+)?$", 1)
    name = F.regexp_extract(test_id, r"^test::(.+?)::(.+?)(?::\d+)?$", 2)
    return F.coalesce(named, F.when(F.length(full_name) > 0, full_name), F.when(F.length(inner) > 0, F.concat_ws("::", inner, name)))


def dedupe_key(test_id: Column, test_file: Column, test_name: Column) -> Column:
    by_id = F.when(F.length(F.trim(test_id)) > 0, F.concat(F.lit("id:"), F.trim(test_id)))
    file, name = slashes(F.trim(test_file)), F.trim(test_name)
    return F.coalesce(by_id, F.when((F.length(file) > 0) & (F.length(name) > 0), F.concat(F.lit("nodeid:"), file, F.lit("::"), name)))


def parse_hash(text: Column) -> Column:
    """Hash of a decoded text, whose line ends count as one kind."""
    return F.md5(F.regexp_replace(text, r"\r\n?", "\n"))


def repo_slug(url: Column) -> Column:
    """owner/name from a remote address in either notation."""
    path = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(url), r"\.git/?$", ""), r"^[a-z+]+://[^/]+/", ""), r"^[^@/]+@[^:/]+:", "")
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.when(F.size(parts) >= 2, F.array_join(F.slice(parts, -2, 2), "/")).when(F.size(parts) == 1, parts[0])


def repo_fingerprint(commit: Column, dirty: Column) -> Column:
    state = F.when(F.length(F.trim(dirty)) > 0, F.substring(F.sha1(dirty), 1, 12)).otherwise("clean")
    return F.when(F.length(commit) > 0, F.concat_ws(":", commit, state)).otherwise("unknown")


def qualify_self(call: Column, class_name: Column) -> Column:
    """self.x within a class is Class.x."""
    return F.when(class_name.isNotNull(), F.regexp_replace(call, r"^(self|cls)\.", F.concat(class_name, F.lit(".")))).otherwise(call)


# -- names of tests ------------------------------------------------------------


def target_names(test_name: Column, least: int = 3) -> Column:
    """Names a test may be about: without test_, every tail after an underscore, Class.test_m -> m."""
    parts, n = F.split(test_name, "_"), F.size(F.split(test_name, "_"))
    plain = F.when(test_name.startswith("test_"), F.array(F.substr(test_name, F.lit(6)))).otherwise(F.array().cast("array<string>"))
    tails = F.when((n > 2) & (parts[0] == "test"), F.transform(F.sequence(F.lit(2), n), lambda i: F.array_join(F.slice(parts, i, n), "_"))).otherwise(F.array().cast("array<string>"))
    dots = F.split(test_name, r"\.")
    method = F.when((F.size(dots) == 2) & F.startswith(F.try_element_at(dots, F.lit(2)), F.lit("test_")), F.array(F.substr(F.try_element_at(dots, F.lit(2)), F.lit(6)))).otherwise(F.array().cast("array<string>"))
    found = F.array_distinct(F.concat(plain, tails, method))
    return F.filter(found, lambda x: (F.length(x) > 0) & (x.contains(".") | x.contains("_") | (F.length(x) >= least)))


def name_tokens(name: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(name), "[^a-z0-9]+"), lambda x: x != ""))


def name_match(target: Column, function: Column) -> Column:
    """0.75 exact, 0.7 dotted suffix, 0.58 contained, else 0.45."""
    return F.when(function == target, 0.75).when(F.endswith(function, F.concat(F.lit("."), target)), 0.7).when(F.contains(function, target), 0.58).otherwise(0.45)


def folder_bonus(a: Column, b: Column) -> Column:
    """0.05 for each common leading directory of two lists, up to 0.2, which four give."""
    same = [F.coalesce(F.get(a, F.lit(i)) == F.get(b, F.lit(i)), F.lit(False)) for i in range(4)]
    count = F.when(~same[0], 0).when(~same[1], 1).when(~same[2], 2).when(~same[3], 3).otherwise(4)
    return F.least(F.lit(0.2), count * 0.05)


def path_words(path: Column) -> Column:
    """Words of a path's directories but for test, tests and src."""
    words = F.flatten(F.transform(directories(F.lower(path)), lambda p: F.split(p, "[_-]")))
    return F.array_distinct(F.filter(words, lambda w: ~w.isin("", "test", "tests", "src")))


def path_similarity(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(path_words(a), path_words(b)))


# -- scores --------------------------------------------------------------------


def impact_score(weight: Column | float, confidence: Column, confidence_weight: float, places: int | None = None) -> Column:
    w = F.lit(weight) if isinstance(weight, (int, float)) else weight
    score = clamp(F.lit(1.0 - confidence_weight) * w + F.lit(confidence_weight) * confidence)
    return F.round(score, places) if places is not None else score


def line_boost(lines: Column, most: float) -> Column:
    return F.when(lines > 0, F.least(F.lit(most), lines / 100.0)).otherwise(0.0)


def boosted_score(weight: Column | float, confidence: Column, confidence_weight: float, lines: Column, most: float) -> Column:
    w = F.lit(weight) if isinstance(weight, (int, float)) else weight
    return clamp(F.lit(1.0 - confidence_weight) * w + F.lit(confidence_weight) * confidence + line_boost(lines, most))


def coverage_link_confidence(ratio: Column) -> Column:
    return F.least(F.lit(1.0), F.lit(0.7) + F.lit(0.3) * ratio)


def coverage_ratio(executed: Column, executable: Column) -> Column:
    """Share of executable lines that ran; all of the executed ones count where none are known as executable."""
    base = F.when(F.size(executable) > 0, executable).otherwise(executed)
    return F.when(F.size(base) > 0, F.size(F.array_intersect(executed, base)) / F.size(base)).otherwise(0.0)


def tier(score: Column) -> Column:
    return F.when(score >= HIGH, "high").when(score >= MEDIUM, "medium").otherwise("low")


def tier_rank(score: Column) -> Column:
    return F.when(score >= HIGH, 0).when(score >= MEDIUM, 1).otherwise(2)


def impact_level(score: Column) -> Column:
    return F.upper(tier(score))


def recommendation(high: Column, total: Column) -> Column:
    """Advice by the number of tests that score HIGH or more."""
    return (
        F.when(total == 0, "No tests impacted. Safe to proceed, but consider adding tests.")
        .when(high == 0, "Low impact detected. Run all tests to be safe.")
        .when(high <= 10, F.concat(F.lit("Run "), high.cast("string"), F.lit(" high-impact tests before committing.")))
        .otherwise(F.concat(F.lit("High impact: "), high.cast("string"), F.lit(" tests affected. Run full test suite.")))
    )


def scaled(x: Column, factor: float = 1e6) -> Column:
    """A score as an integer, half up, for exact comparison between engines."""
    return F.floor(x * F.lit(factor) + F.lit(0.5)).cast("long")


# -- rates and text rules --------------------------------------------------------


def floor_percent(part: Column, whole: Column) -> Column:
    return F.floor(F.lit(100) * part / F.greatest(whole, F.lit(1))).cast("long")


def percent(part: Column, whole: Column, places: int = 2) -> Column:
    return F.when(whole > 0, F.round(F.lit(100.0) * part / whole, places)).otherwise(0.0)


def eta_seconds(elapsed: Column, percent_done: Column) -> Column:
    return F.when((percent_done > 0) & (percent_done < 100), elapsed * (F.lit(100.0) / percent_done - 1))


def eval_workers(cpus: Column, memory_gb: Column, per_worker_gb: float = 4.0, reserve: int = 1) -> Column:
    return F.greatest(F.lit(1), F.least(cpus - reserve, F.floor(memory_gb / per_worker_gb).cast("int")))


def error_category(error: Column) -> Column:
    out = None
    for needle, name in ERROR_RULES:
        hit = F.contains(error, F.lit(needle))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.when(error.isNull() | (F.length(error) == 0), F.lit(None).cast("string")).otherwise(out.otherwise("Other"))


def file_stamp(name: Column) -> Column:
    """Timestamp of a file name with eight and six digits next to each other; null without."""
    digits = F.regexp_extract(name, r"(\d{8})_(\d{6})", 0)
    return F.when(F.length(digits) > 0, F.try_to_timestamp(digits, F.lit("yyyyMMdd_HHmmss")))


def is_blank(text: Column) -> Column:
    return text.isNull() | ~F.rlike(text, F.lit(r"\S"))


def json_list(text: Column) -> Column:
    """A JSON array of strings; a bare word is a list of one, anything empty an empty list."""
    t = F.trim(text)
    parsed = F.from_json(t, "array<string>")
    return F.when(is_blank(text), F.array().cast("array<string>")).when(t.startswith("["), F.coalesce(parsed, F.array().cast("array<string>"))).otherwise(F.array(t))


def failure_signature(**fields: Column) -> Column:
    """First 12 hex digits of the sha1 of the fields' JSON, by name."""
    return F.substring(F.sha1(F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))))), 1, 12)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def paths_in_text(text: Column) -> Column:
    """Python files that a text names, in order, each once."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"([A-Za-z0-9_./-]+\.py)"), 1))
