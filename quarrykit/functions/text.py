"""Text expressions: scrubbing, whitespace coding, hashes, tokens, previews."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = "CHANGE_ME"

# Patterns of secrets, applied in this order.
SECRET_PATTERNS = (
    r"ghp_[A-Za-z0-9]{36,}",
    r"github_pat_[A-Za-z0-9_]{80,}",
    r"hvs\.[A-Za-z0-9_-]{20,}",
    r"AKIA[0-9A-Z]{16}",
    r"eyJ[A-Za-z0-9_=-]+\.eyJ[A-Za-z0-9_=-]+\.[A-Za-z0-9_.=-]+",
    r"-----BEGIN [A-Z ]+PRIVATE KEY-----[\s\S]+?-----END [A-Z ]+PRIVATE KEY-----",
    r"(ssh-rsa|ssh-ed25519|ecdsa-sha2-nistp\d+)\s+[A-Za-z0-9+/=]{40,}",
    r"xox[baprs]-[A-Za-z0-9-]{10,}",
    r"sk_live_[0-9a-zA-Z]{24,}",
    r"[a-zA-Z][a-zA-Z0-9+.\-]*://[^:@/\s]+:[^@/\s]+@[^\s/]+",
)

# Parts of key names whose values are masked.
SENSITIVE_KEYS = (
    "password", "passwd", "secret", "token", "api_key", "apikey", "private_key", "priv_key",
    "client_secret", "refresh_token", "access_token", "vault_role_id", "vault_secret_id", "role_id", "secret_id",
)

#: Whitespace spelled out, as regex dialects disagree about \s.
BLANKS = "[ \\t\\n\\r\\f\\x0B]"
TERM = "[A-Za-z0-9_]{2,}"
#: Blanks that one mark may stand for.
MOST_BLANKS = 1_000_000

# Extensions of path tokens.
PATH_EXTENSIONS = "py|ts|tsx|js|jsx|mjs|cjs|yml|yaml|tf|tfvars|hcl|md|json|sh|bash|j2|jinja|jinja2|tpl|tftpl|Dockerfile"
PATH_TOKEN = rf"\b[a-zA-Z0-9_./-]+\.(?:{PATH_EXTENSIONS})\b"


#: What a text must hold for a pattern to be searched at all, where the search may be slow on long unbroken runs.
_GUARDS = {SECRET_PATTERNS[4]: ".eyJ", SECRET_PATTERNS[5]: "-----END ", SECRET_PATTERNS[9]: "://"}
#: The last pattern from the first letter of a run on: a run of scheme characters is searched once, not from each letter.
_FROM_RUN = {SECRET_PATTERNS[9]: (r"(?<![a-zA-Z0-9+.\-])([0-9+.\-]*+)" + SECRET_PATTERNS[9], "$1" + MASK)}


def scrub(text: Column) -> Column:
    """Every secret replaced by the mask; a second pass changes nothing."""

    def mask(c: Column, pattern: str) -> Column:
        out = F.regexp_replace(c, *_FROM_RUN.get(pattern, (pattern, MASK)))
        return F.when(F.contains(c, F.lit(_GUARDS[pattern])), out).otherwise(c) if pattern in _GUARDS else out

    return reduce(mask, SECRET_PATTERNS, text)


def is_sensitive_key(key: Column) -> Column:
    """Whether a key name, hyphens taken as underscores, contains a sensitive part."""
    return F.replace(F.lower(key), F.lit("-"), F.lit("_")).rlike("|".join(SENSITIVE_KEYS))


def scrub_assignments(text: Column, word: str | None = None) -> Column:
    """``key = "value"`` with a sensitive key: the value replaced by the mask.

    With ``word`` only that word counts as a key, at the end of a longer name
    only behind a sign that is no letter, digit or underscore, and the value
    ends at the next quote, as in texts without escapes.
    """
    if word is not None:
        return F.regexp_replace(text, rf'(?<![A-Za-z0-9_])({word}[ \t\n\r\f\x0B]*+=[ \t\n\r\f\x0B]*+)"[^"]*+"', f'$1"{MASK}"')
    # Possessive and unrolled: a value of any length neither recurses nor is read twice.
    value = r'([ \t\n\r\f\x0B]*+=[ \t\n\r\f\x0B]*+)"[^"\\]*+(?:\\[^\n][^"\\]*+)*+"'
    pattern = r"(?<![A-Za-z0-9_-])[0-9-]*+([A-Za-z_][A-Za-z0-9_-]*+)" + value
    keys = F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))
    sensitive = F.filter(keys, is_sensitive_key)
    # One replacement per sensitive key that occurs; most texts have none.
    masked = F.aggregate(sensitive, text, lambda t, k: F.regexp_replace(t, F.concat(F.lit(r"(?<![A-Za-z0-9_-])([0-9-]*+"), k, F.lit(")" + value)), F.lit(f'$1$2"{MASK}"')))
    return F.when(F.size(sensitive) > 0, masked).otherwise(text)


def compress(text: Column) -> Column:
    """Runs of three or more blanks become ``^n^``."""
    lengths = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(f"({BLANKS}{{3,}})"), F.lit(1)), F.length))
    return F.aggregate(lengths, text, lambda t, n: F.regexp_replace(t, F.concat(F.lit(f"(?<!{BLANKS}){BLANKS}{{"), n.cast("string"), F.lit(f"}}(?!{BLANKS})")), F.concat(F.lit("^"), n.cast("string"), F.lit("^"))))


def decompress(text: Column) -> Column:
    """``^n^`` becomes n spaces; a number beyond ``MOST_BLANKS`` is no mark."""
    marks = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\^(\d+)\^"), F.lit(1)))
    known = F.filter(marks, lambda n: F.coalesce(n.try_cast("int") <= MOST_BLANKS, F.lit(False)))
    return F.aggregate(known, text, lambda t, n: F.replace(t, F.concat(F.lit("^"), n, F.lit("^")), F.repeat(F.lit(" "), n.try_cast("int"))))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def chunk_hash(text: Column) -> Column:
    """Hash of a chunk as stored: scrubbed, then compressed."""
    return content_hash(compress(scrub(text)))


def terms(text: Column) -> Column:
    """Lower-cased terms of two characters or more."""
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def preview(text: Column, length: int = 400) -> Column:
    return F.substring(text, 1, length)


def lines(text: Column) -> Column:
    return F.split(text, "\n")


# F.trim takes the characters to trim as its second argument, so it must not get a line's index.


def first_line(text: Column, length: int = 160) -> Column:
    """The first line that is not blank, without a leading comment marker, cut to ``length``."""
    stripped = F.filter(F.transform(lines(text), lambda s: F.trim(s)), lambda s: (s != "") & ~s.startswith('"""') & ~s.startswith("'''"))
    return F.substring(F.regexp_replace(F.get(stripped, F.lit(0)), r"^(# |// |-- )", ""), 1, length)


def first_body_line(text: Column, length: int = 160) -> Column:
    """The first line that is neither blank nor a heading."""
    stripped = F.filter(F.transform(lines(text), lambda s: F.trim(s)), lambda s: (s != "") & ~s.startswith("#"))
    return F.substring(F.get(stripped, F.lit(0)), 1, length)


def truncate_words(text: Column, limit: int) -> Column:
    """Cut after the last whole word within ``limit``, with an ellipsis; short texts stay."""
    head = F.substring(text, 1, limit)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.rtrim(F.regexp_replace(head, r" [^ ]*$", "")), F.lit("…")))


def short_author(author: Column) -> Column:
    return F.trim(F.regexp_replace(author, r" *<[^>]*>", ""))


def normalized_remote(url: Column) -> Column:
    """One spelling per git remote: https, no credentials, lower-case host, no ``.git``; null for blank."""
    u = F.trim(url)
    u = F.regexp_replace(u, r"^[^@/]+@([^:/]+):(.+)$", "https://$1/$2")
    u = F.regexp_replace(u, r"^(https?://|git://)[^/@]+@", "$1")
    scheme, host, path = (F.regexp_extract(u, r"^([^:/]+://)([^/]*)([\s\S]*)$", i) for i in (1, 2, 3))
    u = F.when(scheme == "", u).otherwise(F.concat(scheme, F.lower(host), path))
    return F.nullif(F.regexp_replace(u, r"\.git$", ""), F.lit(""))


def cache_key(query: Column, kind: Column, lang: Column, k: Column, version: str = "1") -> Column:
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in (query, kind, lang, k)]
    return F.sha2(F.concat_ws("|", *parts, F.lit(version)), 256)


def path_tokens(text: Column) -> Column:
    """Distinct path-like tokens with a known extension."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(PATH_TOKEN), F.lit(0)))


def touched_files(column: Column) -> Column:
    """A JSON array of strings; anything else gives an empty array."""
    return F.coalesce(F.from_json(column, "array<string>"), F.array().cast("array<string>"))


def byte_offset(text: Column, chars: Column) -> Column:
    """UTF-8 bytes before a character position."""
    return F.octet_length(F.substring(text, F.lit(1), chars))


def line_of(text: Column, chars: Column) -> Column:
    """1-based line of a character position."""
    return F.size(F.split(F.substring(text, F.lit(1), chars), "\n"))
