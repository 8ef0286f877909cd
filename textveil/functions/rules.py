"""The pattern rules: one Column of candidate spans per rule, in rule order.

Patterns use Unicode-aware classes written out, so they don't depend on flags of the JDK's regex engine, and possessive
quantifiers with guarded starts, so that long runs of one class are scanned once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from textveil.functions.catalog import CANDIDATE, CANDIDATES, default_selected, none_of
from textveil.functions.spans import find_all

# Classes and keywords of the rules.
WS = r"[\s\p{Z}\x1C-\x1F\x85]"
WORD_START = r"(?<![\p{L}\p{N}_])"
WORD_END = r"(?![\p{L}\p{N}_])"
URL_END = r"""\s\p{Z}'"<>，。；）】"""
RAW = r"[^\s\p{Z},;，；}\]）】]+"
TOKEN_KEYS = "access[_ ]?token|refresh_token|token|访问令牌"
API_KEYS = "api[_ -]?key"
PASSWORD_KEYS = "password|passwd|pwd|数据库密码|登录密码|管理员密码|管理员口令|密码|口令"
SECRET_KEYS = "secret|client_secret"
PERSONAL_ID_END = r"[\p{Nd}Xx]"
OCTET = r"(?:25[0-5]|2[0-4]\p{Nd}|1?\p{Nd}?\p{Nd})"
DOMAIN_SUFFIXES = ("com", "net", "org", "cn", "io", "co", "edu", "gov", "dev", "ai")
DOMAIN_CONTEXT = rf"(?iu)(?:域名|domain|host){WS}*(?:[:：=]|为){WS}*$"
DOMAIN_CONTEXT_CHARS = 16
EMAIL_LOCAL, HOST = "A-Za-z0-9._%+-", "A-Za-z0-9.-"


def keyed(keys: str, seps: str, quotes: str, quoted: str, raw: str) -> str:
    """keyword, optional quote, separator, then a quoted value (groups 2 and 3, after 1) or a raw one (group 4)."""
    return rf'("?(?:{keys})"?{WS}*{seps}{WS}*)(?:([{quotes}])({quoted})[{quotes}]|({raw}))'


def luhn_valid(value: Column) -> Column:
    return F.call_function("luhn_check", F.translate(value, "０１２３４５６７８９", "0123456789"))


def ipv6_valid(value: Column) -> Column:
    """RFC 4291 text forms without dots or zone: eight groups, or fewer around one double colon."""
    full = value.rlike(r"^(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}$")
    groups = F.size(F.filter(F.split(value, ":"), lambda g: g != ""))
    short = (F.regexp_count(value, F.lit("::")) == 1) & ~value.rlike(r":::|[0-9A-Fa-f]{5}|^:[^:]|[^:]:$") & (groups <= 7)
    return full | short


def domain_valid(text: Column, span: Column) -> Column:
    """At least three labels, or a naming keyword just before; a common suffix; labels of 1 to 63 without edge hyphens."""
    labels = F.split(F.lower(span["value"]), r"\.", -1)
    from_ = F.greatest(span["start"] - DOMAIN_CONTEXT_CHARS, F.lit(0))
    named = F.substring(text, from_ + 1, span["start"] - from_).rlike(DOMAIN_CONTEXT)
    good = F.forall(labels, lambda x: F.length(x).between(1, 63) & ~x.startswith("-") & ~x.endswith("-"))
    return ((F.size(labels) >= 3) | named) & F.element_at(labels, -1).isin(*DOMAIN_SUFFIXES) & good


def id_valid(text: Column, span: Column) -> Column:
    return (F.lower(span["key"]) != "valid") & span["value"].rlike(r"\p{Nd}")


DIGIT = r"\p{Nd}"


def folds_oddly(text: Column) -> Column:
    """It has a letter outside ASCII that matches s or i without case, though lower() doesn't give those."""
    return text.contains("ſ") | text.contains("İ")


class Text:
    """A text with what cheap tests of it need: in lower case, whether it has a digit, and whether lower case can be relied on. `detect`
    computes them once per row."""

    def __init__(self, text: Column, low: Column | None = None, digit: Column | None = None, odd: Column | None = None):
        self.text = text
        self.low = F.lower(text) if low is None else low
        self.digit = text.rlike(DIGIT) if digit is None else digit
        self.odd = folds_oddly(text) if odd is None else odd


@dataclass(frozen=True)
class Rule:
    """A category's pattern; lead and value are groups as in find_all, hint a cheap test that any match implies."""

    name: str
    category: str
    pattern: str
    hint: Callable[[Text], Column]
    lead: tuple[int, ...] = ()
    value: tuple[int, ...] = ()
    key: int | None = None
    valid: Callable[[Column, Column], Column] | None = None

    def spans(self, text: Column | Text) -> Column:
        t = text if isinstance(text, Text) else Text(text)
        found = find_all(t.text, self.pattern, self.lead, self.value, self.key, self.hint(t))
        return F.filter(found, lambda s: self.valid(t.text, s)) if self.valid else found


def has(*parts: str) -> Callable[[Text], Column]:
    """The text holds one of the parts as they are."""

    def test(t: Text) -> Column:
        out = F.lit(False)
        for p in parts:
            out = out | t.text.contains(p)
        return out

    return test


def says(*words: str, then: str | None = None) -> Callable[[Text], Column]:
    """The text holds one of the words without regard to case, and matches `then` if given."""

    def test(t: Text) -> Column:
        out = t.odd
        for w in words:
            out = out | t.low.contains(w)
        return out & t.text.rlike(then) if then else out

    return test


def digits(pattern: str) -> Callable[[Text], Column]:
    """The text has digits, and then the pattern."""
    return lambda t: t.digit & t.text.rlike(pattern)


SEP = "(?:[:：=]|为)"
ANY_QUOTE = "\"'`"
RULES = (
    Rule("db_credential", "DB_CREDENTIAL", rf"(?iu){WORD_START}(?:jdbc:[a-z0-9]+|(?:mysql|postgres(?:ql)?|mssql)://)[^{URL_END}]+", hint=has(":")),
    Rule("token", "TOKEN", rf"(?iu){WORD_START}(Bearer{WS}+)([A-Za-z0-9._~+/=-]+)|"
         + keyed(TOKEN_KEYS, SEP, ANY_QUOTE, r"[^\"'`\r\n]*", RAW)
         + rf"|{WORD_START}(eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+)", lead=(1, 3, 4), value=(2, 5, 6, 7), hint=says("bearer", "token", "令牌", "eyj")),
    Rule("api_key", "API_KEY", "(?iu)" + keyed(API_KEYS, SEP, ANY_QUOTE, "[A-Za-z0-9._~-]{12,}", "[A-Za-z0-9._~-]{12,}")
         + rf"|{WORD_START}((?:sk|pk|ak|rk)_[A-Za-z0-9_-]{{12,}}(?<=[A-Za-z0-9_]){WORD_END})", lead=(1, 2), value=(3, 4, 5), hint=says("key", "sk_", "pk_", "ak_", "rk_")),
    Rule("password", "PASSWORD", "(?iu)" + keyed(PASSWORD_KEYS, SEP, ANY_QUOTE, r"[^\"'`\r\n]*", RAW), lead=(1, 2), value=(3, 4), hint=says("passw", "pwd", "密码", "口令")),
    Rule("secret", "SECRET", "(?iu)" + keyed(SECRET_KEYS, "[:=]", "\"'", r"[^\"'\r\n]*", RAW), lead=(1, 2), value=(3, 4), hint=says("secret")),
    Rule("id", "ID", rf'(?iu)(?<![A-Za-z0-9_])("?([A-Za-z][A-Za-z0-9_]*id|id)"?{WS}*[:=]{WS}*)(?:(")([A-Za-z0-9_-]{{3,}})"|([A-Za-z0-9_-]{{3,}}))',
         lead=(1, 3), value=(4, 5), key=2, hint=lambda t: t.digit & says("id", then=rf'(?iu)id"?{WS}*[:=]')(t), valid=id_valid),
    Rule("id_card", "ID_CARD", rf"(?<!\p{{Nd}})\p{{Nd}}{{17}}{PERSONAL_ID_END}(?!{PERSONAL_ID_END})", hint=digits(r"\p{Nd}{17}")),
    Rule("bank_card", "BANK_CARD", r"(?<!\p{Nd})\p{Nd}{16,19}(?!\p{Nd})", hint=digits(r"\p{Nd}{16}"), valid=lambda text, s: luhn_valid(s["value"])),
    Rule("phone", "PHONE", r"(?<!\p{Nd})(?:\+86[- ]?)?1[3-9]\p{Nd}{9}(?!\p{Nd})", hint=digits(r"1[3-9]\p{Nd}{9}")),
    Rule("email", "EMAIL", rf"(?<![{EMAIL_LOCAL}])[{EMAIL_LOCAL}]++@(?=[{HOST}]*\.[A-Za-z]{{2,}}(?![{HOST}]))[{HOST}]++", hint=has("@")),
    Rule("url", "URL", rf"(?iu){WORD_START}https?://[^{URL_END}]+", hint=has("://")),
    Rule("ipv4", "IP", rf"(?<![\p{{Nd}}.]){OCTET}(?:\.{OCTET}){{3}}(?![\p{{Nd}}.])", hint=digits(r"\p{Nd}\.\p{Nd}")),
    Rule("domain", "DOMAIN", rf"(?<![{HOST}])(?:[A-Za-z0-9-]++\.)++[A-Za-z]{{2,}}(?![{HOST}])", hint=lambda t: t.text.rlike(rf"(?i)\.(?:{'|'.join(DOMAIN_SUFFIXES)})"), valid=domain_valid),
    Rule("ipv6", "IP", r"(?<![0-9A-Fa-f:])[0-9A-Fa-f:]{2,}+", hint=has(":"), valid=lambda text, s: s["value"].contains(":") & ipv6_valid(s["value"])),
)
BY_NAME = {r.name: r for r in RULES}


def rule_candidates(text: Column | Text, defaults: dict[str, bool] | None = None, rules: tuple[Rule, ...] = RULES) -> Column:
    """Candidates of all rules, in rule order; ord numbers them."""

    text = text if isinstance(text, Text) else Text(text)

    def one(rule: Rule) -> Column:
        chosen = default_selected(F.lit(rule.category), defaults)
        return F.transform(rule.spans(text), lambda s: F.struct(
            F.lit(rule.category).alias("category"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"),
            F.lit("rule").alias("source"), chosen.alias("selected"), F.lit(0).alias("ord")).cast(CANDIDATE))

    return F.concat(none_of(CANDIDATES), *[one(r) for r in rules])
