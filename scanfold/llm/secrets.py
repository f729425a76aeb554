"""Credentials embedded in code and configuration.

First every string of a text is scored by characters per subword under a public tokenizer's
vocabulary: a string that nobody wrote as language falls into many short pieces, so that a random
key has below two characters a piece, a made-up password below five, and names and prose more.
Then context decides how unnatural a string must be to count as a credential: below ``CHOSEN`` where
it is assigned to a password, stands in a command or header, or has the form of a service's tokens;
below ``WEAK`` in contexts that hold other things too; below ``RANDOM``, with the look of a key, where nothing
but its place as a value speaks for it. A text without an unnatural string has no credential. Found
spans are exact, so masking changes nothing else.
"""

from __future__ import annotations

import base64
import bisect
import math
import re
from collections.abc import Callable, Iterator

# Token forms of public services.
SERVICE_TOKENS = [
    r"(?:AKIA|ASIA|ABIA|ACCA)[A-Z0-9]{16}",
    r"AIza[0-9A-Za-z_-]{35}",
    r"(?:sk|rk|pk)_(?:live|test)_[0-9A-Za-z]{16,}",
    r"npm_[0-9A-Za-z]{30,}",
    r"glpat-[0-9A-Za-z_-]{20,}",
    r"hf_[0-9A-Za-z]{30,}",
    r"gh[pousr]_[0-9A-Za-z]{30,}",
    r"github_pat_[0-9A-Za-z_]{40,}",
    r"xox[abeoprs]-[0-9A-Za-z-]{20,}",
    r"xapp-[0-9A-Za-z-]{20,}",
    r"SG\.[0-9A-Za-z_-]{16,}\.[0-9A-Za-z_-]{32,}",
    r"sk-(?:proj-|ant-[a-z0-9]+-|svcacct-)?[0-9A-Za-z_-]{32,}",
    r"pypi-[0-9A-Za-z_-]{40,}",
    r"dop_v1_[0-9a-f]{40,}",
    r"shp(?:at|ss|ca|pa)_[0-9a-fA-F]{32}",
    r"whsec_[0-9A-Za-z+/]{24,}",
    r"ya29\.[0-9A-Za-z_-]{20,}",
    r"dckr_pat_[0-9A-Za-z_-]{20,}",
    r"hv[sb]\.[0-9A-Za-z_-]{24,}",
    r"lin_api_[0-9A-Za-z]{30,}",
    r"key-[0-9a-f]{32}",
    r"eyJ[0-9A-Za-z_-]{8,}\.eyJ[0-9A-Za-z_-]{4,}\.[0-9A-Za-z_-]{8,}",
]
# Parts of names that hold a credential, without separators and in lower case.
SECRET_NAMES = (
    "password passwd passphrase passwort kennwort motdepasse contrasena contraseña clave senha wachtwoord parola "
    "pwd secret token apikey accesskey secretkey privatekey servicekey encryptionkey signingkey masterkey authkey "
    "accountkey sharedaccesskey licensekey sessionkey storagekey credential userpw loginpw dbpw rootpw adminpw"
).split()
SECRET_ENDINGS = ("pass", "pw", "auth")
KEY_FILE = re.compile(r"(?i)(?:^|/)(?:id_(?:rsa|dsa|ecdsa|ed25519)|[^/]*\.(?:key|ppk)|[^/]*[_-]private\.pem)$")
VALUE_FILE = re.compile(r"(?i)(?:^|/)(?:run/)?secrets?/(?P<name>[^/]+)$")
FIELD_FILE = re.compile(r"(?i)(?:^|/)(?:\.pgpass|pgpass\.conf)$")
# Names that hold such a part, but no credential.
PLAIN_NAMES = (
    "maxtokens tokens tokenizer tokencount tokentype tokenurl tokenendpoint secretname secretref secretkeyref passwordfield passwordpolicy "
    "passwordlength passwordhash passwordhint passwordreset passwordfile tokenfile secretfile keyfile tokenlimit tokenname tokenbudget "
    "passwordinput passwordlabel passwordmin passwordmax secretid secretsmanager secretarn tokenttl tokenexpiry compass bypass"
).split()
PLACEHOLDER = re.compile(
    r"""^(?:
      (?:null|nil|none|undefined|true|false|yes|no|on|off|n/?a|tbd|todo|empty|unset|string|bytes|str|text|password|passwd|pwd|secret|token|optional|required|redacted|removed|hidden|masked|example|sample|test|dummy|default|prompt|stdin|env|file|vault)
      | [*x.•#?_=-]+ | (.)\1{3,}
      | <[^<>]*>? | \$\(? .* | %[A-Za-z_]\w*%? | %\(.* | \{\{?.* | \[.*\]? | @.+ | !.+ | \#\{.*
      | (?:vault|env|file|arn|ssm|op|secret|secrets|sops|aws|gcp|gcloud|keyring|keychain|ref|doppler|awssm|azurekv|kms|bws)[:/@].*
      | (?:process\.env|os\.environ|os\.getenv|getenv|env|ENV|config|settings|secrets|vars|var|self|this|args|ctx|request|req|data|local|module|window|import)[.\[(].*
      | [A-Za-z_$][\w$.]*\s*[(\[].*
      | \d{1,7}(?:\.\d+)? | \d+(?:ms|s|m|h|d)
    )$""",
    re.X | re.I,
)
PLACEHOLDER_PART = re.compile(
    r"(?i)change[-_ ]?(?:me|it|this)|replace[-_ ]?(?:me|it|this|with)|your[-_ ]|[-_]here\b|example(?!\.)|placeholder|dummy|xxxx|\*\*\*|\.\.\.|redact|insert[-_ ]|fill[-_ ]?in|to[-_ ]?be[-_ ]?(?:set|done)|goes[-_ ]here|<[a-z]|not[-_ ]?(?:set|real|a[-_ ]real)|fake|todo"
)
CHOSEN, WEAK, RANDOM = 5.0, 2.6, 2.0  # characters per subword below which a string counts, by context
KEY_CHARS = 20  # of a string that counts by itself
# Every rule below needs one of these in the text, or a file that SUSPECT_FILE names. Valid in Java and in Python.
SUSPECT = (
    r"(?i)[0-9a-z_+/-]{20}|pass|pwd|pw|kennwort|clave|senha|contrase|parola|wachtwoord|secret|token|key|credential|auth|bearer|log[- ]?in\b|identified"
    r"|sudo|chpasswd|\bsu\b|curl\b[^|;]*\s-(?:u|-user|-proxy-user)|\b(?:mysql\w*|mariadb)\b|\b(?:docker|podman|helm|az|oc|kubectl|npm|psql|mongo|mongosh|redis-cli|ldapsearch)\b[^|;]*\s-[paw][ =]"
    r"|://[^\s/@]*:[^\s@]*@|[?&;](?:sig|signature|code|access|sas|hmac|k|t)=|:(?:\d{2,5}|\*):[\w*-]+:"
    r"|(?:AKIA|ASIA|ABIA|ACCA)[A-Z0-9]{16}|AIza|[srp]k_(?:live|test)_|npm_|glpat-|hf_|gh[pousr]_|github_pat_|xox[abeoprs]-|xapp-|SG\.|sk-|pypi-|dop_v1_|shp(?:at|ss|ca|pa)_|whsec_|ya29\.|dckr_pat_|hv[sb]\.|lin_api_|eyJ"
)
SUSPECT_FILE = r"(?i)(?:^|[/\\])(?:id_(?:rsa|dsa|ecdsa|ed25519)|[^/\\]*\.(?:key|ppk)|[^/\\]*[_-]private\.pem|secrets?[/\\][^/\\]+)$"
KEY_LETTERS = frozenset("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/=")
BEGIN = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
BREAK = r"(?:\\r)?\\n|\r?\n"

_token = re.compile(r"(?<![0-9A-Za-z_/+.-])(?:" + "|".join(SERVICE_TOKENS) + r")(?![0-9A-Za-z_])")
_pair = re.compile(
    r"""(?<![\w.$-])(?P<name>[A-Za-z_][\w.$-]*+)(?P<q>\\?["'`]?\]?)\s*(?P<op>:=|=>|=(?!=)|:(?!:)|,(?=\s*["'`]))\s*(?P<pre>[rbfu]?)(?:(?P<v1>\\?["'`])(?P<s>[^"'`\\]*(?:\\(?!n)[^"'`\\]*)*)(?P<end>\\?["'`])?|(?P<b>[^\s"'`,;<>(){}\[\]&|]+(?:[(\[][^\s]*)?))"""
)
_xml = re.compile(r"<(?P<name>[A-Za-z_][\w.-]*)(?:\s[^<>]*)?>(?P<v>[^<>\s]+)</(?P=name)>")
_url = re.compile(r"(?<=[a-z0-9])://(?P<user>[^\s:/@\"'<>]*):(?P<v>[^\s/@\"'<>`]+(?:/[^\s/@\"'<>`]*)?)@(?=[\w\[.-])", re.I)
_query = re.compile(r"[?&;](?P<name>[A-Za-z_][\w.-]*)=(?P<v>[^&\s\"'<>`#;)]+)")
_header = re.compile(r"(?i)\b(?:proxy-)?authorization[\"']?\s*[:,=]\s*[\"'`]?\s*(?:(?P<scheme>basic|bearer|token|apikey|digest|negotiate)\s+)?(?P<v>[^\s\"'`,}\\)]+)")
_key_header = re.compile(r"(?i)\bx-(?:[a-z]+-)*(?:key|token|secret|auth|password)[\"']?\s*[:,]\s*[\"'`]?(?P<v>[^\s\"'`,}\\)]+)")
_bearer = re.compile(r"(?i)\bbearer\s+(?P<v>[0-9A-Za-z._~+/-]{16,}=*)")
_commands = [
    re.compile(r"\bsshpass\s+-p\s*[\"']?(?P<v>[^\s\"']+)"),
    re.compile(r"\becho\s+(?:-n\s+)?[\"']?(?P<v>[^\s\"'|]+)[\"']?\s*\|\s*(?:sudo\s+-S|docker\s+login|passwd|chpasswd|su\b)"),
    re.compile(r"--(?:pass(?:word|wd|phrase)?|pwd|token|secret|api-?key|access-?key|secret-?key|auth-?token)[ =][\"']?(?P<v>[^\s\"']+)"),
    re.compile(r"(?i)\bmachine\s+\S+\s+login\s+\S+\s+password\s+(?P<v>\S+)"),
    re.compile(r"(?i)\b(?:password|passwd|passphrase|pwd|passcode|secret|token|api key)\s+(?:is|was|were|are|to|=)\s+[\"'`]?(?P<v>[^\s\"'`,;]+)"),
    re.compile(r"(?i)\blog[- ]?in\s+\S+\s*(?:/|,|with|and)\s*(?:password|passwd|pass|pwd)\s*:?\s*[\"'`]?(?P<v>[^\s\"'`,;]+)"),
    re.compile(r"(?i)\bidentified\s+by\s+[\"'](?P<v>[^\"']+)"),
]
# The name of a command, and the option of it that gives a password, anywhere before the next | or ;
_options = [
    (re.compile(r"\bcurl\b"), re.compile(r"\s(?:-u|--user|--proxy-user)[ =]?[\"']?(?P<user>[^\s:\"']+):(?P<v>[^\s\"']+)")),
    (re.compile(r"\b(?:mysql|mysqldump|mysqladmin|mariadb)\b"), re.compile(r"\s-p(?P<v>[^\s\"']+|(?<=-p)[\"'][^\"']+)")),
    (re.compile(r"\b(?:docker|podman|helm|az|oc|kubectl|npm|psql|mongo|mongosh|redis-cli|ldapsearch)\b"), re.compile(r"\s(?:--password|-p|-a|-w)[ =][\"']?(?P<v>[^\s\"'-][^\s\"']*)")),
]
_auth_entry = re.compile(r"\"auth\"\s*:\s*\"(?P<v>[0-9A-Za-z+/]{8,}={0,2})\"")
_npm = re.compile(r":_(?:authToken|auth|password)\s*=\s*[\"']?(?P<v>[^\s\"']+)")
_fields = re.compile(r"^\s*[\w.*-]+:(?:\d{2,5}|\*):[\w*-]+:[\w*.-]+:(?P<v>[^\s:]+)\s*$")
_env_name = re.compile(r"(?:^|[\s{,-])[\"']?name[\"']?\s*:\s*[\"']?(?P<name>[A-Za-z_][\w.-]*)[\"']?\s*,?\s*$")
_env_value = re.compile(r"^\s*[\"']?value[\"']?\s*:\s*(?:[\"'](?P<s>[^\"']*)[\"']?|(?P<b>[^\s\"']+))")
_secret_kind = re.compile(r"^\s*kind:\s*[\"']?Secret\b")
_data_line = re.compile(r"^\s+[\w.-]+:\s*[\"']?(?P<v>[0-9A-Za-z+/]{4,}={0,2})[\"']?\s*$")
_key_lines = re.compile(r"^(?:[0-9A-Za-z+/=]+(?:\\n|\n|$))+$")
_one_value = re.compile(r"^\s*[^\s:=\"'<>]+\s*$")
_weak_query = {"key", "sig", "signature", "code", "auth", "access", "sas", "hmac", "k", "t"}
_stop = re.compile(r"[|;]")
_string = re.compile(r"(?:[^\s\"'`<>(){}\[\],;|=:@/\\]|\\(?!r?\\?n))+")
_run = re.compile(r"[^\W_]{1,1000}")  # a longer run is scored piece by piece
_value = re.compile(r"""(?:(?P<q>["'`])|[=:]\s*)(?P<v>[0-9A-Za-z_+/.~-]{%d,}=*)(?(q)(?P=q)|(?=[\s,;}\])]|$))""" % KEY_CHARS)
# What a random string is without being a credential, told by the words before it.
PLAIN_CONTEXT = re.compile(
    r"(?i)(?:sha-?\d*|md5|digest|hash|checksum|crc|integrity|commit|revision|\brev|etag|uuid|guid|id|fingerprint|thumbprint|public|pub|cert(?:ificate)?|ssh-\w+|ecdsa-\S+"
    r"|base64,?|data|atob|decode\w*|src|href|ur[li]|path|file|image|font|icon|version|regex|pattern|rule|name|title|text|message|content|payload|sample|example|signature|nonce|seed)"
    r"[\w.-]*[\"'`\])]*\s*(?:[:=,(]|=>|\s)*\s*[\"'`]?$"
)


def plain_name(name: str) -> str:
    return re.sub(r"[^a-z0-9ñ]", "", name.lower())


def is_secret_name(name: str) -> bool:
    """Does a variable or field of this name hold a credential, by convention?"""
    last = name.replace("$", "").split(".")[-1]
    flat = plain_name(last)
    if flat in PLAIN_NAMES or flat.startswith("public") or flat.endswith(("tokens", "url", "uri", "path", "file", "policy", "length", "hash", "name", "id", "type", "field", "ttl", "expiry", "regex", "pattern", "hint")):
        return flat.endswith(("accesskeyid",))
    if any(s in flat for s in SECRET_NAMES):
        return True
    if flat.endswith("pass"):
        return True
    parts = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", last).lower()
    return re.split(r"[^a-z0-9ñ]+", parts)[-1] in SECRET_ENDINGS


def is_placeholder(value: str) -> bool:
    return not value or PLACEHOLDER.match(value) is not None or PLACEHOLDER_PART.search(value) is not None


def naturalness(value: str, count: Callable[[str], int]) -> float:
    """Characters per subword, over the value's runs of letters and digits.

    Endless for a value without any, and for a word in lower case that the vocabulary has as one piece, however short.
    """
    runs = _run.findall(value)
    if not runs or len(runs) == 1 and runs[0].isalpha() and runs[0].islower() and 1 in (count(runs[0]), count(" " + runs[0])):
        return math.inf
    return sum(map(len, runs)) / sum(map(count, runs))


def unnatural(text: str, count: Callable[[str], int], below: float = CHOSEN) -> list[tuple[int, int, float]]:
    """(start, end, characters per subword) of every string of a text that has fewer than ``below``, in order."""
    return [(m.start(), m.end(), n) for m in _string.finditer(text) if (n := naturalness(m.group(), count)) < below]


def find(text: str, count: Callable[[str], int], file: str | None = None) -> list[tuple[int, int, str]]:
    """Spans (start, end, rule) of the credentials in a text, in order, without overlaps.

    ``file`` is where the text is from: a part from the middle of a key file is key, and a file
    of mounted secrets is one value.

    ``count`` gives the number of subwords of a string. Line breaks may be real or the two
    characters ``\\n``; `...` at an end means that the text goes on there.
    """
    lo = 3 if text.startswith("...") else 0
    hi = len(text) - 3 if text.endswith("...") and len(text) >= lo + 3 else len(text)
    found: list[tuple[int, int, str]] = []
    marks = unnatural(text, count)
    if not marks:
        return found

    def add(a: int, b: int, rule: str, limit: float = CHOSEN) -> None:
        """The span counts if an unnatural enough string reaches into it, and no other span does."""
        b = min(b, hi)
        k = bisect.bisect_left(found, (a,))
        if a >= b or k < len(found) and b > found[k][0] or k and found[k - 1][1] > a:
            return
        at = bisect.bisect_left(marks, (b,))
        while at and marks[at - 1][1] > a:
            at -= 1
            if marks[at][2] < limit and (marks[at][0] >= a and marks[at][1] <= b or naturalness(text[a:b], count) < limit):
                found.insert(k, (a, b, rule))
                return

    file = (file or "").replace("\\", "/")
    _private_keys(text, lo, hi, add)
    if not found and KEY_FILE.search(file) and _key_lines.match(text[lo:hi]):
        add(lo, hi, "key file", WEAK)
    if (m := VALUE_FILE.search(file)) and is_secret_name(m.group("name")) and _one_value.match(text[lo:hi]) and not is_placeholder(text[lo:hi].strip()):
        body = text[lo:hi]
        add(lo + len(body) - len(body.lstrip()), lo + len(body.rstrip()), "value file")
    for m in _token.finditer(text, lo, hi):
        if not PLACEHOLDER_PART.search(m.group()) and not re.search(r"(.)\1{7,}", m.group()):
            add(*m.span(), "service token", WEAK)
    lines = _lines(text, lo, hi)
    secret_kind = False
    for k, (a, b) in enumerate(lines):
        line = text[a:b]
        secret_kind = secret_kind or _secret_kind.match(line) is not None
        _line(line, lambda x, y, r, limit=CHOSEN: add(a + x, a + y, r, limit), FIELD_FILE.search(file) is not None)  # noqa: B023
        if secret_kind and (m := _data_line.match(line)) and not re.match(r"\s*(?:name|namespace|type|kind|apiVersion)\s*:", line):
            add(a + m.start("v"), a + m.end("v"), "secret data")
        if k and (m := _env_value.match(line)) and (n := _env_name.search(text[lines[k - 1][0] : lines[k - 1][1]])):
            g = "s" if m.group("s") is not None else "b"
            v = m.group(g)
            if is_secret_name(n.group("name")) and not is_placeholder(v):
                add(a + m.start(g), a + m.end(g), "environment")
        for m in _value.finditer(line):
            if _like_key(m.group("v")) and not PLAIN_CONTEXT.search(line, max(0, m.start() - 80), m.start("v")) and not is_placeholder(m.group("v")):
                add(a + m.start("v"), a + m.end("v"), "random value", RANDOM)
    return found


def _like_key(v: str) -> bool:
    """Letters of both cases and digits, and neither a path, an address nor a text in base64."""
    if not (re.search("[a-z]", v) and re.search("[A-Z]", v) and re.search("[0-9]", v)) or v.startswith(("http", "/", "./")) or v.count("/") > len(v) // 12:
        return False
    try:
        return not base64.b64decode(v, validate=True).decode().isprintable()
    except ValueError:
        return True


def _lines(text: str, lo: int, hi: int) -> list[tuple[int, int]]:
    out, at = [], lo
    for m in re.finditer(BREAK, text[:hi]):
        if m.start() >= at:
            out.append((at, m.start()))
            at = m.end()
    return [*out, (at, hi)]


def _private_keys(text: str, lo: int, hi: int, add: Callable[[int, int, str], None]) -> None:
    at = lo
    while m := BEGIN.search(text, at, hi):
        e = END.search(text, m.end(), hi)
        stop = e.end() if e else hi
        other = text.find("-----BEGIN ", m.end(), stop)
        if other >= 0:
            stop = other
        add(m.start(), stop, "private key")
        at = stop
    if (e := END.search(text, lo, hi)) and not BEGIN.search(text, lo, e.start()):  # its beginning isn't shown
        add(_key_start(text, lo, e.start()), e.end(), "private key")


def _key_start(text: str, lo: int, at: int) -> int:
    """Where the lines of key characters that end at ``at`` begin."""
    while br := next((br for br in ("\\r\\n", "\\n", "\r\n", "\n") if at - len(br) >= lo and text.startswith(br, at - len(br))), None):
        end = k = at - len(br)
        while k > lo and text[k - 1] in KEY_LETTERS:
            k -= 1
        if lo < k < end and text[k - 1] == "\\" and text[k] == "n":  # of a break, not of the key
            k += 1
        if k == end:
            break
        at = k
    return at


def _option_matches(line: str, name: re.Pattern, option: re.Pattern) -> Iterator[re.Match]:
    """The first option after each name, with no | or ; in between. One pass: no search starts before the last one's end."""
    at, stop, m = 0, -1, None
    for n in name.finditer(line):
        if n.start() < at:
            continue
        if m is None or m.start() < n.end():
            m = option.search(line, n.end())
            if m is None:
                return
        if stop < n.end():
            stop = next((x.start() for x in _stop.finditer(line, n.end())), len(line))
        if m.start() < stop:
            yield m
            at = m.end()


def _line(line: str, add: Callable[..., None], field_file: bool) -> None:
    for m in _url.finditer(line):
        if not is_placeholder(m.group("v")):
            add(*m.span("v"), "address")
    for rx, rule in ((_header, "header"), (_key_header, "header"), (_bearer, "header"), (_auth_entry, "auth entry"), (_npm, "npm")):
        for m in rx.finditer(line):
            v = m.group("v")
            if not is_placeholder(v) and len(v) >= 4:
                add(*m.span("v"), rule, WEAK if rx is _header and not m.group("scheme") else CHOSEN)
    for m in _query.finditer(line):
        n, v = m.group("name"), m.group("v")
        if (is_secret_name(n) or plain_name(n) in _weak_query) and not is_placeholder(v) and len(v) >= 10:
            add(*m.span("v"), "query", WEAK)
    for ms in [*(_option_matches(line, *o) for o in _options), *(rx.finditer(line) for rx in _commands)]:
        for m in ms:
            if not is_placeholder(m.group("v")):
                add(*m.span("v"), "command")
    for m in _xml.finditer(line):
        if is_secret_name(m.group("name")) and not is_placeholder(m.group("v")):
            add(*m.span("v"), "element")
    if (m := _fields.match(line)) and not is_placeholder(m.group("v")):
        add(*m.span("v"), "fields")
    for m in _pair.finditer(line):
        g = "s" if m.group("s") is not None else "b"
        v = m.group(g)
        if is_secret_name(m.group("name")) and not is_placeholder(v) and (g == "s" or _bare(v)):
            add(*m.span(g), "pair", WEAK if " " in v.strip() else CHOSEN)


def _bare(v: str) -> bool:
    """Can an unquoted value be a literal? In code it is a name, a number or a call instead."""
    return not re.search(r"[()\[\]{}]", v)


def masked(text: str, spans: list[tuple[int, int, str]], mask: str = "*") -> str:
    """The text with every found character replaced by ``mask``: offsets and all else stay.

    Line breaks inside a private key stay too, so that line numbers don't move.
    """
    for a, b, _ in reversed(spans):
        text = text[:a] + re.sub(r"(\\n|\n)|.", lambda m: m.group(1) or mask, text[a:b], flags=re.S) + text[b:]
    return text
