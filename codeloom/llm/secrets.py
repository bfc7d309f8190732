"""Credentials embedded in source code: located exactly, validated, and replaced by placeholders.

A keyword automaton picks the lines of a body that may hold a credential; places whose name and value may stand on several
lines, and pairs in comments, are looked for in whole bodies. There, issuer formats and the places where credentials
stand (named values, headers, connection strings, addresses, logins, settings files, comments) give candidate spans,
which are kept when their structure holds: a JWT's header is JSON, basic authentication decodes to user and password, a
named value has the composition of a secret and not of a label, a placeholder, a hash or an identifier. Values that are
written in joined pieces are matched with the joints taken out and reported from their first to their last character.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What the automaton looks for, in lower case.
KEYWORDS = [
    "-----begin", "ghp_", "gho_", "ghs_", "ghu_", "ghr_", "github_pat_", "glpat-", "sk-", "sk_live_", "rk_live_", "pk_live_", "sk_test_", "rk_test_", "pk_test_",
    "xoxb-", "xoxp-", "xoxa-", "xoxr-", "xoxs-", "npm_", "sg.", "hooks.slack", "aiza", "akia", "asia", "eyj", "pass", "pw", "sig=", "signature=", " -u", "--user", "signin", "secret", "token", "key", "kennwort", "clave", "contrase", "credential", "bearer ", "basic ", "://", "login", "curl ", "auth", "until",
]

_ISSUED = re.compile(
    r"(?<![A-Za-z0-9_\-])(?:"
    r"(?P<sum>(?:gh[pousr]|npm)_(?P<body>[A-Za-z0-9]{30})(?P<crc>[A-Za-z0-9]{6}))|github_pat_[A-Za-z0-9_]{40,90}|glpat-[A-Za-z0-9_\-]{20}|(?:sk|rk|pk)_(?:live|test)_[A-Za-z0-9]{24,}|sk-(?:[a-z0-9]+-)?[A-Za-z0-9]{32,}"
    r"|xox[abprs]-\d{8,}-\d{8,}-[A-Za-z0-9]{20,}|AIza[A-Za-z0-9_\-]{35}|(?:AKIA|ASIA)[A-Z0-9]{16}|SG\.[A-Za-z0-9_\-]{22}\.[A-Za-z0-9_\-]{43}"
    r"|(?P<jwt>eyJ[A-Za-z0-9_\-]{8,}\.eyJ[A-Za-z0-9_\-]{4,}\.[A-Za-z0-9_\-]{16,})"
    r")(?![A-Za-z0-9])"
)
# Runs are possessive, so that a pattern takes a text of any length in linear time and needs no bound.
_PRIVATE_KEY = re.compile(r"-----BEGIN (?P<kind>[A-Z ]*)PRIVATE KEY(?P<block> BLOCK)?-----(?:(?!-----BEGIN )[\s\S])*?-----END (?P=kind)PRIVATE KEY(?P=block)?-----|-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?!-----)[\s\S])*?-----END [A-Z ]*PRIVATE KEY-----")
_QUOTED = r"(?P<q>[\"'`])(?P<v>(?:(?!(?P=q))[^\\\n]|\\.)*+)(?P=q)"
_ENV = r"(?:(?:process\.env|import\.meta\.env|Deno\.env)[\w.\[\]\"'()]*+\s*+(?:\?\?|\|\|)\s*+)?"
_NAMED = re.compile(rf"(?<![\w$])(?P<n>[A-Za-z_$][\w$]*+)[\"']?\s*+(?:\?\s*+)?(?::\s*+[\w<>\[\], |]++\s*+=|[:=](?!=))\s*+{_ENV}{_QUOTED}")
_ENV_FALLBACK = re.compile(rf"process\.env\.(?P<n>\w++)\s*+(?:\?\?|\|\|)\s*+{_QUOTED}")
_HEADER = re.compile(rf"[\"'](?P<n>[A-Za-z][\w-]*+)[\"']\s*+(?:\]\s*+[!=]?={{1,3}}|,|:)\s*+{_QUOTED}")
_BEARER = re.compile(r"\b(?:Bearer|bearer|BEARER)\s++(?P<v>[A-Za-z0-9+/=._~\-]{12,})")
_BASIC = re.compile(r"\b(?:Basic|basic|BASIC)\s++(?P<v>[A-Za-z0-9+/]{8,}={0,2})(?![A-Za-z0-9+/=])")
_USERINFO = re.compile(r"://[^\s:/@\"'`?#]*+:(?P<v>[^\s/@\"'`]++)@")
_SETTING = re.compile(r"(?:(?<=[;\"'`\s])|^)(?:password|pwd|passwd)\s*+=\s*+(?P<v>[^;\s\"'`]++)(?=\s*+[;\"'`])", re.I)
_ACCOUNT_KEY = re.compile(r"\b(?:AccountKey|SharedAccessKey)\s*+=\s*+(?P<v>[A-Za-z0-9+/]{40,}={0,2})", re.I)
_WEBHOOK = re.compile(r"hooks\.slack\.com/services/(?P<v>T[A-Z0-9]{6,}/B[A-Z0-9]{6,}/[A-Za-z0-9]{16,})")
_DOTENV = re.compile(r"(?:^|(?<=[\n\"'`])|(?<=\\n))[ \t]*+(?:export[ \t]++)?(?P<n>[A-Z][A-Z0-9_]*+)=(?P<v>(?:(?!\\n)[^\s\"'`])+)", re.M)
#: A line of a settings file: no quotes, and nothing after the value.
_YAML = re.compile(r"(?:^|(?<=[\"'`])|(?<=\\n))[ \t]*+(?:-[ \t]++)?(?P<n>[A-Za-z][\w.-]*+):[ \t]++(?P<v>[A-Za-z0-9+/=_\-!@%^&*~]{12,})(?=[ \t]*+(?:#[^\n]*)?(?:$|\\n|[\"'`]))", re.M)
_QUERY = re.compile(r"[?&](?:api_?key|access_?token|auth_?token|token|key|secret|client_secret|password|pwd|sig|signature)=(?P<v>[^&\s\"'`#<>]++)", re.I)
_LOGIN = re.compile(rf"\.(?:login|signIn|signin|authenticate|auth)\(\s*+(?:\"[^\"\n]*+\"|'[^'\n]*+'|`[^`\n]*+`)\s*+,\s*+{_QUOTED}")
_CURL = re.compile(r"\s(?:-u|--user)[ =]++[\"']?[^\s:\"'`]++:(?P<v>[^\s\"'`]++)")
#: Where a comment begins, and what in it names a credential; the rest of the comment's line is searched for the latter.
_LEAD = re.compile(r"(?<![:\w])//|/\*|^[ \t]*+\*", re.M)
_NOTE = re.compile(r"\b(?:password|passwort|kennwort|passphrase|passwd|pass|pwd|pw|secret|token|api key|mot de passe|contraseña|clave)\b(?:\s++(?:was|is|war|ist|lautet|era|es|était|est)(?=[\s:=]))?\s*+[:=]?\s*+[\"'`]?(?P<v>[^\s\"'`]{6,})", re.I)
_NOTE_LOGIN = re.compile(r"\b(?:login|user|account|zugang|usuario|compte)\s++[^\s/]++\s*+/\s*+(?P<v>[^\s\"'`]{6,})", re.I)
_NOTE_PAIR = re.compile(r"(?:(?<![:\w])//|/\*)[^\S\n]*+[A-Za-z][\w.]*+:(?P<v>(?!//)[^\s\"'`]{6,})(?=\s)")

_GOES_ON = re.compile(r"\+\s*+$")
_COMES_ON = re.compile(r"\n\s*+\+\s*+[\"'`]")
_MAY_HOLD = re.compile(r"[\"'`]|//|/\*|^\s*\*|^\s*(?:export )?[A-Z][A-Z0-9_]*=|://|\s-u\s|^\s*(?:- +)?[A-Za-z][\w.-]*+:[ \t]+\S{12}", re.M)
_JOINT = re.compile(r"([\"'`])\s*+\+\s*+([\"'`])")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
# Words of names that hold credentials, and words that say a name holds something about them instead.
SECRET_WORDS = {"password", "passwd", "passwort", "passphrase", "passcode", "passe", "pass", "pwd", "pw", "secret", "secrets", "token", "credential", "credentials", "kennwort", "clave", "contrasena", "apikey", "key"}
ABOUT_WORDS = {
    "algorithm", "asset", "checksum", "column", "count", "digest", "endpoint", "error", "expiry", "field", "file", "format", "hash", "header", "help", "hint", "icon", "id", "ids", "index", "issuer", "kind", "label",
    "length", "limit", "link", "message", "mode", "name", "names", "path", "pattern", "placeholder", "policy", "prefix", "prompt", "regex", "regexp", "rule", "size", "status", "text", "title", "total", "ttl", "type", "uri", "url", "version",
}
_PLACEHOLDER = re.compile(
    r"(?i)^(?:.*(?:change[-_ ]?me|replace[-_ ]?me|your[-_ ]|placeholder|example|dummy|redacted|insert[-_ ]|fill[-_ ]?in|not[-_ ]?set|tbd\b|to[-_ ]?do\b|fixme).*|todo|none|null|undefined|true|false|test|secret|password|token|(.)\1*|[x*.\-_#0]+|<[^>]*>|\{\{.*\}\}|%[\w]+%|\[[^\]]*\])$"
)
_UUID = re.compile(r"(?i)^[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}$")


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word in KEYWORDS:
        found.add_word(word, word)
    found.make_automaton()
    return found


def _joined(text: str) -> tuple[str, list[tuple[int, int]]]:
    """The text without the joints of string pieces, and (place in it, characters taken out before) in order."""
    kept, cuts, last, gone = [], [], 0, 0
    for m in _JOINT.finditer(text):
        kept.append(text[last : m.start()])
        gone += m.end() - m.start()
        cuts.append((m.end() - gone, gone))
        last = m.end()
    if not cuts:
        return text, cuts
    return "".join([*kept, text[last:]]), cuts


def _place(at: int, cuts: list[tuple[int, int]]) -> int:
    moved = 0
    for place, gone in cuts:
        if place > at:
            break
        moved = gone
    return at + moved


def _is_name(name: str) -> bool:
    """Whether a value of this name may be a credential."""
    words = [w.lower() for w in _PARTS.findall(name)]
    if not words or not SECRET_WORDS.intersection(words) or words[-1] in ABOUT_WORDS or "public" in words:
        return False
    return True


def _is_free(value: str) -> bool:
    """Not a placeholder, a template or a reference."""
    return len(value) >= 6 and "${" not in value and not _PLACEHOLDER.match(value) and not value.startswith(("$", "process.env", "vault:", "env:", "arn:", "ref:"))


def _is_mixed(value: str) -> bool:
    """Composed like a secret: letters with digits, or capitals where a word would have none."""
    if not _is_free(value) or re.search(r"\s|://|[(){}]", value) or _UUID.match(value) or len(value) < 8:
        return False
    letters, digits = re.search(r"[A-Za-z]", value), re.search(r"\d", value)
    if letters and digits:
        return not re.fullmatch(r"v?\d+(?:\.\d+)+[\w.\-]*", value)
    if not (re.search(r"[a-z]", value) and re.search(r"[A-Z]", value)):
        return False
    return not re.fullmatch(r"[A-Za-z]?[a-z]+(?:[A-Z][a-z]+)*(?:[-_.:/ ][A-Za-z]?[a-z]+(?:[A-Z][a-z]+)*)*", value)


def _is_jwt(value: str) -> bool:
    head = value.split(".")[0]
    try:
        return isinstance(json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4))), dict)
    except (ValueError, binascii.Error):
        return False


_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def _has_checksum(body: str, crc: str) -> bool:
    """Whether the last characters are the CRC-32 of those before them in base 62, as some issuers write their tokens."""
    value = 0
    for c in crc:
        value = value * 62 + _BASE62.index(c)
    return value == binascii.crc32(body.encode())


def _is_varied(value: str) -> bool:
    """Not a stand-in of few different characters."""
    return len(set(value)) >= 10 and not _PLACEHOLDER.match(value)


def _is_issued(match: re.Match) -> bool:
    """A token with its checksum is one; older ones, which have none, must look drawn at random, and a JWT have a header."""
    if match["sum"] and _has_checksum(match["body"], match["crc"]):
        return True
    return _is_jwt(match["jwt"]) if match["jwt"] else _is_varied(match[0])


def _is_basic(value: str) -> bool:
    try:
        user, colon, password = base64.b64decode(value + "=" * (-len(value) % 4)).decode("utf-8").partition(":")
    except (ValueError, binascii.Error):
        return False
    return bool(colon and user and password) and user.isprintable() and password.isprintable() and _is_free(password)


#: Names under which even a value of small letters alone is a password.
_PASSWORD_NAMES = {"password", "passwd", "pwd", "pass", "passphrase", "passwort", "kennwort"}


def _is_named(match: re.Match) -> bool:
    if not _is_name(match["n"]):
        return False
    return _is_mixed(match["v"]) or (_PARTS.findall(match["n"])[-1].lower() in _PASSWORD_NAMES and bool(re.fullmatch(r"[a-z]{8,}", match["v"])) and _is_free(match["v"]))


_PLACES: list[tuple[re.Pattern, Callable[[re.Match], bool]]] = [
    (_BEARER, lambda m: _is_free(m["v"]) and _is_mixed(m["v"])),
    (_BASIC, lambda m: _is_basic(m["v"])),
    (_USERINFO, lambda m: _is_free(m["v"])),
    (_SETTING, lambda m: _is_free(m["v"])),
    (_DOTENV, lambda m: _is_name(m["n"]) and _is_mixed(m["v"])),
    (_QUERY, lambda m: _is_mixed(m["v"])),
    (_LOGIN, lambda m: _is_mixed(m["v"])),
    (_CURL, lambda m: _is_free(m["v"])),
    (_ACCOUNT_KEY, lambda m: _is_mixed(m["v"])),
    (_WEBHOOK, lambda m: _is_varied(m["v"])),
    (_YAML, lambda m: _is_name(m["n"]) and _is_strong(m["v"]) and bool(re.search(r"\d.*[A-Za-z]", m["v"]))),
    (_NOTE_PAIR, lambda m: _is_mixed(m["v"])),
    (_NAMED, _is_named),
    (_ENV_FALLBACK, lambda m: _is_name(m["n"]) and _is_mixed(m["v"])),
    (_HEADER, lambda m: _is_name(m["n"]) and _is_mixed(m["v"])),
]


#: Patterns that are looked for in the rest of a comment's line.
_NOTES: list[tuple[re.Pattern, Callable[[re.Match], bool]]] = [(_NOTE, lambda m: _is_mixed(m["v"])), (_NOTE_LOGIN, lambda m: _is_mixed(m["v"]))]


def _note_spans(text: str, pattern: re.Pattern, holds: Callable[[re.Match], bool]) -> list[tuple[int, int]]:
    """Spans of what `pattern` finds first after the beginning of each comment, on its line; the value may be on the next one."""
    found, done = [], 0
    for lead in _LEAD.finditer(text):
        if lead.start() < done:
            continue
        end = text.find("\n", lead.end())
        end = len(text) if end < 0 else end
        after = text.find("\n", end + 1)
        match = pattern.search(text, lead.end(), len(text) if after < 0 else after)
        if match and match.start() < end:
            done = match.end()
            if holds(match):
                found.append(match.span("v"))
        else:
            done = end
    return found


def _spans(text: str, lead: str = "") -> list[tuple[int, int]]:
    """(start, end) of the credentials of one part of a text, apart from private keys."""
    flat, cuts = _joined(text)
    flat = lead + flat
    found = [m.span() for m in _ISSUED.finditer(flat) if _is_issued(m)]
    for pattern, holds in _PLACES:
        found += [m.span("v") for m in pattern.finditer(flat) if holds(m)]
    for pattern, holds in _NOTES:
        found += _note_spans(flat, pattern, holds)
    return [(_place(a - len(lead), cuts), _place(b - 1 - len(lead), cuts) + 1) for a, b in set(found) if a >= len(lead)]


_DAY_OR_ISSUE = re.compile(r"\d{4}-\d\d-\d\d.*|[A-Z]+-\d+|.*[/\\#@].*")


def _is_strong(value: str) -> bool:
    """Mixed so clearly that no other word needs to say it is a credential."""
    return _is_mixed(value) and all(re.search(c, value) for c in ("[a-z]", "[A-Z]", r"\d")) and not _DAY_OR_ISSUE.fullmatch(value)


def _on_lines(match: re.Match) -> bool:
    """Whether the value belongs to the name although they may stand on different lines: no line ends before a `=` after a type."""
    return not re.match(r"[^=]*\n[^=]*=", match.string[match.end("n") : match.start("v")])


#: Places that may go on over several lines.
_BODY_PLACES: list[tuple[re.Pattern, Callable[[re.Match], bool]]] = [
    (_LOGIN, lambda m: _is_mixed(m["v"])),
    (_NAMED, lambda m: _is_named(m) and _on_lines(m)),
    (_ENV_FALLBACK, lambda m: _is_name(m["n"]) and _is_mixed(m["v"])),
    (_HEADER, lambda m: _is_name(m["n"]) and _is_mixed(m["v"])),
]
#: Comments that no keyword announces; each is on one line.
_NOTE_PLACES: list[tuple[re.Pattern, Callable[[re.Match], bool]]] = [
    (_NOTE_PAIR, lambda m: _is_strong(m["v"]) and "\n" not in m[0]),
]


def _body_spans(text: str, named: bool) -> list[tuple[int, int]]:
    """(start, end) of the credentials whose place may go on over lines, and of those in comments without a keyword."""
    places = (_BODY_PLACES if named else []) + (_NOTE_PLACES if "//" in text or "*" in text else [])
    flat, cuts = _joined(text) if places else ("", [])
    found = {m.span("v") for pattern, holds in places for m in pattern.finditer(flat) if holds(m)}
    if "//" in flat or "*" in flat:
        found.update(_note_spans(flat, _NOTE_LOGIN, lambda m: _is_mixed(m["v"]) and "\n" not in m[0]))
    return [(_place(a, cuts), _place(b - 1, cuts) + 1) for a, b in found]


def _parts(text: str, words: ahocorasick.Automaton) -> tuple[bool, bool, list[tuple[int, int]]]:
    """Whether there is a keyword, whether there may be a private key, and the ranges of the lines that may hold another credential."""
    low = text.lower()
    if len(low) != len(text):
        return True, True, [(0, len(text))]
    ranges: list[tuple[int, int]] = []
    met, key, last = False, False, 0
    for at, word in words.iter(low):
        met = True
        key = key or word == "-----begin"
        if at < last:
            continue
        start, end = text.rfind("\n", 0, at) + 1, text.find("\n", at)
        end = len(text) if end < 0 else end
        while _GOES_ON.search(text, start, end) and end < len(text):  # a value in pieces may go on in the next line
            end = text.find("\n", end + 1)
            end = len(text) if end < 0 else end
        while end < len(text) and _COMES_ON.match(text, end):
            end = text.find("\n", _COMES_ON.match(text, end).end())
            end = len(text) if end < 0 else end
        last = end
        if _MAY_HOLD.search(text, start, end):
            ranges.append((start, end))
    return met, key, ranges


def secret_spans(text: str, name: str = "", words: ahocorasick.Automaton | None = None) -> list[tuple[int, int]]:
    """(start, length) of every credential in `text`; `name` is what the whole text is the value of, if anything."""
    if name:
        keys = [m.span() for m in _PRIVATE_KEY.finditer(text)]
        found = _spans(text, f"{name} = ")
    else:
        met, key, ranges = _parts(text, words or _automaton())
        keys = [m.span() for m in _PRIVATE_KEY.finditer(text)] if key else []
        found = [(low + a, low + b) for low, high in ranges for a, b in _spans(text[low:high])]
        if ranges != [(0, len(text))]:
            found += _body_spans(text, met)
    kept = list(keys)
    for span in sorted(set(found), key=lambda s: (s[1] - s[0], s)):  # of overlapping ones the tightest
        if all(span[1] <= k[0] or span[0] >= k[1] for k in kept):
            kept.append(span)
    return [(a, b - a) for a, b in sorted(kept)]


_STAND_IN = str.maketrans({**{c: "x" for c in "abcdefghijklmnopqrstuvwxyz"}, **{c: "X" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}, **{c: "0" for c in "123456789"}})
_MARKS = re.compile(r"-----(?:BEGIN|END) [A-Z ]+-----|\\.|[\"'`]\s*\+\s*[\"'`]")


def redacted(text: str, spans: list[tuple[int, int]]) -> str:
    """The text with each span replaced by a placeholder of its length and alphabet.

    Letters become x or X and digits 0; delimiters, the marks of key blocks, escapes and joints stay, so the code still parses.
    """
    out, last = [], 0
    for start, length in spans:
        out.append(text[last:start])
        value, at = text[start : start + length], 0
        for m in _MARKS.finditer(value):
            out += [value[at : m.start()].translate(_STAND_IN), m.group()]
            at = m.end()
        out.append(value[at:].translate(_STAND_IN))
        last = start + length
    return "".join([*out, text[last:]])


def _find(redact: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _automaton()
        for batch in batches:
            ids: list[int] = []
            starts: list[int] = []
            sizes: list[int] = []
            texts: list[str] = []
            for rec, name, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                spans = secret_spans(text, name, words)
                if redact:
                    ids.append(rec)
                    texts.append(redacted(text, spans))
                    starts.append(len(spans))
                else:
                    for start, size in spans:
                        ids.append(rec)
                        starts.append(start)
                        sizes.append(size)
            if redact:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array(starts, pa.int64())], ["id", "text", "n_secrets"])
            else:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (ids, starts, sizes)], ["id", "secret_start", "secret_len"])

    return run


def _texts(records: DataFrame, id_col: str, text_col: str, name_col: str | None) -> DataFrame:
    name = F.col(name_col) if name_col else F.lit(None)
    return records.select(F.col(id_col).cast("long").alias("id"), name.cast("string").alias("name"), F.col(text_col).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")


def find_secrets(records: DataFrame, id_col: str, text_col: str, name_col: str | None = None) -> DataFrame:
    """(id, secret_start, secret_len): one row per credential; positions count code points from 0.

    `name_col` is the name of the constant that holds the text, if the records are such. Null and empty texts hold nothing;
    texts of any length are searched whole; rows that repeat an id and a place are one; an empty table gives an empty result;
    other columns are ignored.
    """
    return _texts(records, id_col, text_col, name_col).mapInArrow(_find(False), "id long, secret_start long, secret_len long").distinct()


def redact_secrets(records: DataFrame, id_col: str, text_col: str, name_col: str | None = None) -> DataFrame:
    """(id, text, n_secrets): every row's text with its credentials replaced by placeholders of the same length and alphabet."""
    return _texts(records, id_col, text_col, name_col).mapInArrow(_find(True), "id long, text string, n_secrets long")
