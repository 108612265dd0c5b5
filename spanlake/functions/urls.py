"""Links: their parts, and whether they point at something private; natively."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanlake import rules
from spanlake.functions.spans import let, no_spans, scan

PUNCTUATION = ".,;:!?'\"*"


def trimmed(match: Column) -> Column:
    """Without trailing sentence punctuation and closing brackets that nothing opens."""
    tail = F.regexp_extract(match, "[.,;:!?'\"*)]*$", 0)
    count = lambda s, c: F.length(s) - F.length(F.replace(s, F.lit(c), F.lit("")))

    def step(s: Column, _: Column) -> Column:
        last = F.right(s, F.lit(1))
        drop = last.isin(*PUNCTUATION) | ((last == ")") & (count(s, "(") < count(s, ")")))
        return F.when(drop, F.left(s, F.length(s) - 1)).otherwise(s)

    return F.when(tail == "", match).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(tail), F.lit(1))), match, step))


def _head(text: Column, at: str) -> Column:
    return F.substring_index(text, at, 1)


def _tail(text: Column, at: str) -> Column:
    """What is after the first `at`; nothing if there is none."""
    i = F.instr(text, at)
    return F.when(i > 0, F.call_function("substring", text, i + len(at))).otherwise(F.lit(""))


def url_struct(url: Column) -> Column:
    """STRUCT(scheme, userinfo (null if none), host, path, query, fragment); no other validation."""
    one = let(url, lambda u: F.struct(F.when(F.instr(u, "://") > 0, _head(u, "://")).otherwise(F.lit("")).alias("scheme"), F.when(F.instr(u, "://") > 0, _tail(u, "://")).otherwise(u).alias("rest")))
    two = let(one, lambda p: F.struct(p["scheme"].alias("scheme"), _head(p["rest"], "#").alias("rest"), _tail(p["rest"], "#").alias("fragment")))
    three = let(two, lambda p: F.struct(p["scheme"].alias("scheme"), _head(p["rest"], "?").alias("rest"), _tail(p["rest"], "?").alias("query"), p["fragment"].alias("fragment")))
    four = let(
        three,
        lambda p: F.struct(
            p["scheme"].alias("scheme"), _head(p["rest"], "/").alias("authority"), F.when(F.instr(p["rest"], "/") > 0, F.concat(F.lit("/"), _tail(p["rest"], "/"))).otherwise(F.lit("")).alias("path"),
            p["query"].alias("query"), p["fragment"].alias("fragment"),
        ),
    )
    return let(
        four,
        lambda p: F.struct(
            p["scheme"].alias("scheme"), F.when(F.instr(p["authority"], "@") > 0, F.regexp_extract(p["authority"], "^(?s)(.*)@", 1)).alias("userinfo"),
            F.substring_index(F.substring_index(p["authority"], "@", -1), ":", 1).alias("host"), p["path"].alias("path"), p["query"].alias("query"), p["fragment"].alias("fragment"),
        ),
    )


def url_parts(url: Column) -> dict[str, Column]:
    p = url_struct(url)
    return {k: p[k] for k in ("scheme", "userinfo", "host", "path", "query", "fragment")}


def matches_any(host: Column, domains: Sequence[str]) -> Column:
    """Equal to one of the domains or under it: one lookup for each of the host's suffixes."""
    return F.arrays_overlap(suffixes(host), literals(domains)) if domains else F.lit(False)


def suffixes(host: Column) -> Column:
    """a.b.c, b.c, c"""
    return let(F.split(host, "\\.", -1), lambda labels: F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))


def literals(values: Sequence[str]) -> Column:
    """An array literal, one constant in the plan."""
    return F.split(F.lit("\n".join(values)), "\n")


def under_any(host: Column, domains: Sequence[str]) -> Column:
    """Under one of the domains, not equal to it."""
    return matches_any(host, domains) & ~host.isin(*domains)


def private_host(host: Column) -> Column:
    local = (host == "localhost") | host.endswith(".localhost")
    return ~local & ((F.instr(host, ".") == 0) | F.substring_index(host, ".", -1).isin(*rules.PRIVATE_SUFFIXES))


def identifier_token(token: Column) -> Column:
    size = F.length(token)
    without = lambda p: size - F.length(F.regexp_replace(token, p, ""))
    digits, upper, lower = without("[0-9]"), without("[A-Z]"), without("[a-z]")
    return (
        ((size >= 32) & token.rlike("^[0-9A-Fa-f]+$"))
        | ((digits == size) & (size >= 9))
        | ((size >= 20) & (digits > 0) & (upper > 0) & (lower > 0))
        | ((size >= 24) & (digits >= 4) & (F.instr(token, "-") == 0))
    )


def carries_identifier(segment: Column) -> Column:
    """An address, UUID, long digest or number, or a token that looks random."""
    runs = F.regexp_extract_all(segment, F.lit(f"({rules.TOKEN_RUN})"), 1)
    return F.replace(segment, F.lit("%40"), F.lit("@")).rlike(rules.EMAIL_LIKE) | segment.rlike(rules.UUID) | F.exists(runs, identifier_token)


def sensitive_query(query: Column) -> Column:
    """A pair whose key is sensitive or whose value carries an identifier; empty values don't count."""

    def pair(p: Column) -> Column:
        both = let(p, lambda x: F.struct(F.when(F.instr(x, "=") > 0, F.lower(_head(x, "="))).otherwise(F.lit("")).alias("key"), F.when(F.instr(x, "=") > 0, _tail(x, "=")).otherwise(x).alias("value")))
        return let(both, lambda b: (b["value"] != "") & (b["key"].isin(*rules.SENSITIVE_KEYS) | b["key"].rlike("|".join(rules.SENSITIVE_KEY_PARTS)) | carries_identifier(b["value"])))

    return F.exists(F.split(query, "[&;]", -1), pair)


def private_path(path: Column) -> Column:
    """Names an account or a network share, or carries an identifier."""

    def judged(segments: Column) -> Column:
        at = lambda i: F.lower(F.try_element_at(segments, F.lit(i)))
        account = (
            F.when(at(1).isin("home", "users", "media"), at(2))
            .when((at(1) == "run") & (at(2) == "media"), at(3))
            .when((at(1) == "mnt") & (at(3) == "users"), at(4))
        )
        return F.coalesce(~account.isin(*rules.SHARED_HOMES), F.lit(False)) | F.exists(segments, carries_identifier)

    named = let(F.filter(F.split(path, r"[/\\]", -1), lambda s: (s != "") & ~s.endswith(":")), judged)
    return path.startswith("\\\\") | named


def private_url(url: Column, public_domains: Sequence[str] = ()) -> Column:
    """Whether a link leads to something private, carries an identifier, or belongs to
    a host that is neither known as public nor listed."""
    known = [*rules.PUBLIC_DOMAINS, *(d.strip().removeprefix("www.").lower() for d in public_domains)]

    def judged(p: Column) -> Column:
        host, segments, ends = p["host"], p["segments"], p["suffixes"]
        under = lambda domains: F.arrays_overlap(ends, literals(domains))
        first = F.try_element_at(segments, F.lit(1))
        work = first.isin("in", "pub", "company", "school", "showcase") & (F.size(segments) > 1)
        person = under(rules.PROFILE_DOMAINS) & first.isNotNull() & ~F.lower(first).isin(*rules.SITE_PAGES)
        other = (
            host.rlike(rules.IPV4)
            | private_host(host)
            | (under(rules.TENANT_DOMAINS) & ~host.isin(*rules.TENANT_DOMAINS) & ~host.startswith("www."))
            | ((F.size(segments) > 0) & under(rules.DOCUMENT_DOMAINS))
            | F.coalesce(F.when(under(["linkedin.com"]), work).otherwise(person), F.lit(False))
            | F.exists(segments, lambda s: s.startswith("@") | carries_identifier(s))
            | sensitive_query(p["query"])
            | sensitive_query(p["fragment"])
            | ~under(known)
        )
        file = private_path(F.ltrim(p["path"], F.lit("/"))) | private_path(p["path"])
        return F.when(F.lower(p["scheme"]) == "file", file).when(p["userinfo"].isNotNull(), F.lit(True)).when(host == "", F.lit(False)).otherwise(other)

    ready = let(
        url_struct(url),
        lambda p: F.struct(
            p["scheme"].alias("scheme"), p["userinfo"].alias("userinfo"), F.lower(p["host"]).alias("host"), suffixes(F.lower(p["host"])).alias("suffixes"), p["path"].alias("path"), p["query"].alias("query"), p["fragment"].alias("fragment"),
            F.filter(F.split(p["path"], "/", -1), lambda s: s != "").alias("segments"),
        ),
    )
    return let(ready, judged)


def links(text: Column, order: int = 100) -> Column:
    """Every link in the text, trimmed."""
    found = F.when(F.contains(text, F.lit("://")) | text.rlike(r"(?i)www\."), scan(text, rules.URL, "URL", rules.URL_SCORE, order)).otherwise(no_spans())

    return F.transform(F.transform(found, lambda s: s.withField("text", trimmed(s["text"]))), lambda s: s.withField("end", (s["start"] + F.octet_length(s["text"])).cast("int")))


def private_links(text: Column, public_domains: Sequence[str] = (), order: int = 100) -> Column:
    return F.filter(links(text, order), lambda s: private_url(s["text"], public_domains))


def normalized_domain(entry: Column) -> Column:
    """A listed domain without scheme, user, what follows the host, www. and final dot; null
    if what is left isn't two labels at least."""
    d = F.lower(F.trim(entry))
    for pattern in ("^[a-z][a-z0-9+.-]*://", "^[^@/]*@", "[/?#:].*$", "^www\\.", "\\.$"):
        d = F.regexp_replace(d, pattern, "")
    return F.when(d.rlike("^(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\\.)+[a-z][a-z0-9-]{1,62}$"), d)
