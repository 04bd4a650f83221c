"""Credentials embedded in source code, found and redacted (problem 1).

Every place of a text that can hold a credential is looked at: string literals with the name they are assigned to, bare
assignments of configuration and prose, URLs with user information, authorisation headers, connection strings, command
options, tokens of known shape and private keys. Values that can be an encoding are decoded (base64, hexadecimal, percent
and escape sequences), layer by layer until nothing decodes any more, and what comes out is scanned again; binary results are parsed to their end by the grammar of
key containers (DER keys, PKCS #12, OpenSSH, Java key stores), which must hold a private or secret key. If a decoded layer holds a credential, the enclosing
encoded literal is the finding. Literals that are put together (by ``+``, side by side, over lines, in multi-line strings) are
judged as one value, as are here-documents and block scalars of one value. Redaction replaces the value and leaves quotes, separators and line ends alone.
"""

from __future__ import annotations

import base64
import binascii
import re
import urllib.parse
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from math import log2
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import spread

MARK = "REDACTED"
#: Length from which on a value needs a name that ends with the word for a credential; its content is examined at any length.
LONG = 4096


class Finding(NamedTuple):
    start: int
    end: int
    line_no: int
    kind: str
    layers: int
    #: The places of a value that stands in several literals or lines, else empty.
    parts: tuple[tuple[int, int], ...] = ()


# Words of names that hold credentials, and words that say that a name holds something about one.
SECRET_WORDS = {"password", "passwd", "pwd", "passphrase", "pass", "passwort", "secret", "token", "apikey", "credential", "credentials", "cred", "creds", "authtoken", "accesstoken", "privatekey", "secretkey", "psk"}
KEY_WORDS = {"api", "access", "private", "secret", "signing", "encryption", "auth", "client", "account", "master", "shared", "session", "service", "admin", "deploy", "license", "aes", "hmac", "crypto", "app", "root", "ssh", "storage", "subscription", "webhook", "login"}
ABOUT_WORDS = {
    "label", "pattern", "regex", "regexp", "hint", "prompt", "placeholder", "id", "ids", "name", "field", "hash", "sha", "sha1", "sha256", "sha512", "md5", "checksum", "digest", "etag",
    "pub", "public", "length", "len", "count", "size", "type", "expiry", "expires", "ttl", "path", "file", "prefix", "suffix", "format", "error", "message", "title", "image", "icon", "version",
    "commit", "url", "uri", "endpoint", "env", "var", "column", "index", "integrity", "fingerprint", "help", "text", "description", "rule", "policy", "scope", "limit", "kind", "class", "count",
}

# what a line must show to be looked at: words and marks, in lower case, each alternative beginning with its letter, which the
# engine skips to; long runs; literals that go on
_MARKS = re.compile(
    r"pass|pwd|psk|secret|session|sign_?in|sk_|sg\.|token|key|cred|connect|auth|akia|asia|aiza|bearer|-----begin|-u\b|--user|://[^\s/\"'`@]*@|ghp_|gho_|ghu_|ghs_|ghr_|github_pat|glpat|xox[abprs]-|eyj|log_?in|log_?on|"
    r"\\x[0-9a-f]{2}(?:\\x[0-9a-f]{2}){3}|\\u[0-9a-f]{4}(?:\\u[0-9a-f]{4}){3}|%[0-9a-f]{2}%[0-9a-f]{2}%[0-9a-f]{2}"
)
_LONG = re.compile(r"[A-Za-z0-9+/_\-]{24}")
_ADDED = re.compile(r"""["'`][ \t)]*\+""")
_LITERAL = re.compile(r"""(?m)("""  # noqa: ISC001
    r'''"""|\'\'\'|["'`])((?:\\(?:\r?\n|.)|(?!\1)[^\n\\])*)(\1|$)''')
# what stands between two literals of one value, and the line ends that such a value or an escaped line end goes on over
_GAP = re.compile(r"""(?:(?:[\s)]|\\\r?\n|(?://|\#)[^\n]*\n)*\+(?:[\s(]|\\\r?\n|(?://|\#)[^\n]*\n)*|(?:\s|\\\r?\n|(?://|\#)[^\n]*\n)*)[bBrRuUfFL]{0,2}""")
_SOFT = (
    re.compile(r"""["'`][ \t)]*(?:\+|\\)?[ \t]*(?:(?://|\#)[^\n]*)?\r?(\n)[ \t]*(?:\+[ \t(]*)?[bBrRuUfFL]{0,2}(?=["'`])"""),
    re.compile(r"""[=(][ \t]*\r?(\n)[ \t]*[bBrRuUfFL]{0,2}(?=["'`])"""),
    re.compile(r"""\\\r?(\n)"""),
)
_ESCAPED_END = re.compile(r"\\\r?\n")
_BLOCK = re.compile(r"""(?<=[=:(])[ \t]*[bBrRuUfF]{0,2}("""  # noqa: ISC001
    r'''"""|\'\'\'|`)(?=[^\n"'`]*\n)''')
# here-documents and block scalars: the name, and the lines that hold the value
_HERE = re.compile(r"""([A-Za-z_][\w.\-]*)[^\n]{0,40}?<<[-~]?[ \t]*["']?([A-Za-z_]\w*)["']?[^\n]*\n""")
_SCALAR = re.compile(r"""(?m)^([ \t]*)(?:-[ \t]+)?["']?([A-Za-z_][\w.\-]*)["']?:[ \t]*[|>][-+]?[ \t]*\r?\n""")
_NAME = re.compile(r"""([A-Za-z_$][\w$.\-]*)["'\]]{0,2}\s*(?::\s*[&'\w<>\[\] .]+?\s*)?(?::=|=>|==|=|:|,|\()\s*(?:\(|\{|new\s+\w+\(|[bBrRuUfF]{1,2}(?=["'])|&|String::from\(|\[\]byte\(|std::string\(|std::string\{)*\s*$""")
_BREAK = re.compile(r"""[;"'`{}\n]""")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_URL = re.compile(r"[A-Za-z][A-Za-z0-9+.\-]*://([^\s:/@\"'`<>]*):([^\s@\"'`/]*(?:/[^\s@\"'`/]+)?)@[\w\[]")
_HEADER = re.compile(r"(?i)\b(?:proxy-)?authorization[\"']?\s*[:=,]\s*[\"']?\s*(?:bearer|token|basic|apikey)\s+([^\s\"'`]+)|\b(?:bearer)\s+([A-Za-z0-9+/_.=~\-]{16,})|\bx-(?:api-key|auth-token|access-token|vault-token)[\"']?\s*[:=,]\s*[\"']?\s*([^\s\"'`]+)")
_PART = re.compile(r"(?i)(?:^|[;?&,\s{\"'(])((?:account|shared|access|api|private|secret|client|user)?[ _-]?(?:password|passwd|pwd|pass|secret|token|key|accountkey|sharedaccesskey|apikey|signature|sig))\s*=\s*([^;&\s\"'`,)}]+)")
_OPTION = re.compile(r"(?i)(?:^|\s)--?(?:[a-z]+-)*(?:token|password|passwd|pass|secret|api-?key|access-?key|private-?key|auth|key)(?:=|\s+)([^\s\"'`]+)|(?:^|\s)(?:-u|--user)[= ]\s*[\w.\-]+:([^\s\"'`]+)|(?:mysql|mysqldump|psql|sshpass)\b[^\n\"'`]*?\s-p\s?([^\s\"'`-][^\s\"'`]*)")
_KNOWN = re.compile(
    r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b|\bgh[pousr]_[A-Za-z0-9]{30,}|\bgithub_pat_\w{30,}|\bxox[abprs]-[A-Za-z0-9-]{10,}|\b[sr]k_(?:live|test)_[A-Za-z0-9]{16,}|\bAIza[\w\-]{35}|\bglpat-[\w\-]{18,}|\bnpm_[A-Za-z0-9]{30,}|\bSG\.[\w\-]{16,}\.[\w\-]{16,}|\beyJ[\w\-]{6,}\.[\w\-]{6,}\.[\w\-]{6,}"
)
# issuer and kind as short lower-case segments, then the random part
_ISSUED = re.compile(r"(?<![\w.\-/])[a-z]{2,6}(?:[._\-][a-z]{2,6}){1,2}[._\-]([A-Za-z0-9]{24,})(?![\w/])")
_LOGIN = re.compile(r"(?i)(?:^|[\s.(=>:])\w*(?:log_?in|sign_?in|log_?on|connect|authenticate|open_?session|set_?credentials|basic_?auth|auth)\w*\s*\([^()\"'`]*[\"'`][^\"'`]*[\"'`]\s*,\s*$")
_SAID = re.compile(r"(?i)(?:\bis\b|->|=>|→)\s*[\"'`]?([^\s\"'`]+)")
_STOP = re.compile(r"[^\w \t]")
_COMMENT = re.compile(r"^\s*(?://|#|\*|--|<!--|/\*|;|>|[-*] )")
_SPOKEN = re.compile(r"(?i)\b(?:password|passwd|pwd|pass|passphrase|secret|token|api key|access key|key|credentials?)\b")
_VALUE = re.compile(r"[^\s\"'`<>]{10,}")
_PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?)-----")
_PEM_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
# lines of a key whose end is missing: headers, and whole lines of base64 as they stand in texts, literals and comments
_PEM_LINES = re.compile(r"""(?:(?:\\r)?(?:\\n)?[\s"'`+,;()*\#]*(?:\\r|\\n|//[ \t])*(?:(?:Proc-Type|DEK-Info|Version|Comment):[^\n\\]*|(?:[A-Za-z0-9+/]{16,}={0,2}|[A-Za-z0-9+/]{2,15}={1,2}))(?=[\s"'`,;\\]|\Z))*""")
_RUN = re.compile(r"[A-Za-z0-9+/=]{16,}")
_PEM_SECRET = re.compile(r"(?m)-----(BEGIN|END)[A-Z0-9 ]*-----|(\\[nrt])|(?:[A-Za-z0-9+/=]{8,}|[A-Za-z0-9+/]{2,7}={1,2})(?=[\s\"'`,;+\\]|-----|$)")
_BARE = re.compile(r"(?:^|[\s\"'`(\[{,;>*#/|-])([A-Za-z_][\w.\-]*)[\"'`*]*\s*(?::=|=|:)\s*([^\s\"'`]+)")
_PLACE = re.compile(
    r"(?ix)^(?:.*(?:\$\{|\{\{|\$\(|%\(|<[\w\s-]+>|\{[a-z_]\w*\}|%[sdv]\b|\#\{).*|\$[A-Z_a-z]\w*|%\w+%|@\w+@|\{\w*\}|<.*>|\[.*\]"
    r"|(.)\1{3,}.*|[x*.\-_•#]+|(?:vault|env|ref|secret|ssm|arn|file|kms|keyring|config)[:/].*|.*(?:change[-_ ]?me|change[-_ ]?this|placeholder|replace[-_ ]?(?:me|this|with)|your[-_ ]|not[-_ ]a[-_ ]|to[-_]?do\b|redacted|dummy|example|sample[-_ ]|insert[-_ ]|fixme|masked|\.invalid$|goes[-_ ]here).*"
    r"|none|null|nil|undefined|true|false|test|testing|secret|password|passwd|token|empty|default|tbd|n/a|foo|bar|foobar|xxx+|abc(?:123)?|process\.env.*|os\.environ.*|os\.getenv.*|getenv.*|env\..*)$"
)
_PATTERN = re.compile(r"\[[^\]]*-[^\]]*\]|\\[dwsb]|\{\d+,?\d*\}|^\^|\$$|\(\?")
_B64 = re.compile(r"^[A-Za-z0-9+/_\-]{12,}={0,2}$")
_HEX = re.compile(r"^(?:0x)?(?:[0-9a-fA-F]{2}){8,}$")
_PCT = re.compile(r"%[0-9a-fA-F]{2}")
_CHAIN = re.compile(r"%(?:25)+(?=[0-9a-fA-F]{2})")
_ESC = re.compile(r"\\x[0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\}|\\[0-7]{3}|\\[nrt\"'\\/]")


def _entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * log2(c / n) for c in Counter(s).values()) if n else 0.0


def _name_kind(name: str, length: int = 0) -> str:
    """'' if the name doesn't speak of a credential, 'secret' for one, 'key' for a key. A value of more than ``LONG`` characters is
    data of something else unless the name ends with the word (token, but not token_table)."""
    w = [x.lower() for x in _WORDS.findall(name)]
    kind, at = "", 0
    for k, x in enumerate(w):
        if x in SECRET_WORDS:
            kind, at = "secret", k
        elif x in ("key", "keys") and k and w[k - 1] in KEY_WORDS:
            kind, at = kind or "key", k
    # what a name is about stands after the secret's word: token_count, but label_token
    return kind if ABOUT_WORDS.isdisjoint(w[at + 1 :]) and (length <= LONG or at == len(w) - 1) else ""


def _strong(v: str) -> bool:
    """Whether the value of a credential's name is one, and no word, path or expression."""
    if len(v) < 6 or any(c.isspace() for c in v) or _PLACE.match(v) or _PATTERN.search(v):
        return False
    letters = sum(c.isalpha() for c in v)
    digits = sum(c.isdigit() for c in v)
    marks = len(v) - letters - digits
    if digits == 0 and re.fullmatch(r"[A-Za-z]+(?:[_\-./: ][A-Za-z]+)*|[a-z]+(?:[A-Z][a-z]+)*", v):
        return len(v) >= 16 and _entropy(v) > 3.6 and bool(re.search(r"[a-z][A-Z][A-Z]|[A-Z]{2}[a-z]|[a-z][A-Z][a-z][A-Z]", v))
    if not letters and not (digits >= 8 and marks):
        return digits >= 6 and len(v) >= 8
    if re.fullmatch(r"[a-z]+(?:[_\-./][a-z]+)*\d{0,2}|[A-Z]+(?:_[A-Z0-9]+)+", v):
        return False
    return _entropy(v) > 2.2 and bool(digits or marks or re.search(r"[a-z][A-Z]", v))


# --- binary grammars of key containers ---


def _der(b: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, start, end) of the element at ``at``, or None."""
    if at + 2 > end:
        return None
    tag, n, at = b[at], b[at + 1], at + 2
    if n & 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4 or at + k > end:
            return None
        n, at = int.from_bytes(b[at : at + k], "big"), at + k
    return (tag, at, at + n) if at + n <= end else None


def _children(b: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    out = []
    while at < end:
        e = _der(b, at, end)
        if e is None:
            return None
        out.append(e)
        at = e[2]
    return out


class _Reader:
    """Fields of a big-endian binary format; ``IndexError`` where the bytes end too early."""

    def __init__(self, b: bytes, at: int = 0):
        self.b, self.at = b, at

    def take(self, n: int) -> bytes:
        if n > len(self.b) - self.at:
            raise IndexError
        self.at += n
        return self.b[self.at - n : self.at]

    def number(self, n: int = 4) -> int:
        return int.from_bytes(self.take(n), "big")

    def field(self, n: int = 4) -> bytes:
        return self.take(self.number(n))


def _is_openssh(b: bytes) -> bool:
    """Cipher, KDF, its options, public keys, and a private part of whole blocks that begins, if it isn't encrypted, with a number twice."""
    r = _Reader(b, len(b"openssh-key-v1\0"))
    cipher, kdf = r.field(), r.field()
    r.field()
    keys = r.number()
    if not 1 <= keys <= len(b) or not cipher.isascii() or (kdf == b"none") != (cipher == b"none"):
        return False
    for _ in range(keys):
        if not _Reader(r.field()).field().isascii():
            return False
    private = r.field()
    return len(b) - r.at <= 64 and len(private) % 8 == 0 and (cipher != b"none" or (len(private) >= 16 and private[:4] == private[4:8]))


def _is_key_store(b: bytes) -> bool:
    """Entries with at least one private (tag 1) or secret key (tag 3), and a digest of 20 bytes at the end. A trust store is none."""
    r = _Reader(b, 4)
    version, count, keys = r.number(), r.number(), 0
    if version not in (1, 2):
        return False

    def certificate() -> None:
        if version == 2:
            r.field(2)
        if not _children(x := r.field(), 0, len(x)):
            raise IndexError

    for _ in range(count):
        tag = r.number()
        r.field(2)
        r.take(8)
        if tag == 1:
            if not _children(x := r.field(), 0, len(x)):
                return False
            for _ in range(r.number()):
                certificate()
        elif tag == 2:
            certificate()
        elif tag == 3:
            # a serialised object, whose length only its own grammar tells: what follows it cannot be walked
            return r.take(4) == b"\xac\xed\x00\x05" and len(b) - r.at > 20
        else:
            return False
        keys += tag == 1
    return keys > 0 and len(b) - r.at == 20


# Object identifiers in DER of data, encrypted data, and bags of plain and encrypted keys.
_DATA, _ENCRYPTED = bytes.fromhex("2a864886f70d010701"), bytes.fromhex("2a864886f70d010706")
_KEY_BAGS = (bytes.fromhex("2a864886f70d010c0a0101"), bytes.fromhex("2a864886f70d010c0a0102"))


def _holds_bag(b: bytes, at: int, end: int) -> bool:
    """Whether the safe contents in ``b[at:end]`` have a bag of a key."""
    top = _der(b, at, end)
    for x in (_children(b, top[1], top[2]) or []) if top and top[0] == 0x30 else []:
        e = _children(b, x[1], x[2]) if x[0] == 0x30 else None
        if e and e[0][0] == 0x06 and b[e[0][1] : e[0][2]] in _KEY_BAGS:
            return True
    return False


def _is_pkcs12(b: bytes, content: tuple[int, int, int]) -> bool:
    """The authenticated safe: content infos of data, one of which holds a bag of a key, or of encrypted data."""
    c = _children(b, content[1], content[2])
    if not c or len(c) != 2 or c[0][0] != 0x06 or b[c[0][1] : c[0][2]] != _DATA or c[1][0] != 0xA0:
        return False
    octets = _der(b, c[1][1], c[1][2])
    safe = _der(b, octets[1], octets[2]) if octets and octets[0] == 0x04 else None
    infos = _children(b, safe[1], safe[2]) if safe and safe[0] == 0x30 else None
    found = False
    for x in infos or []:
        e = _children(b, x[1], x[2]) if x[0] == 0x30 else None
        if not e or len(e) != 2 or e[0][0] != 0x06 or e[1][0] != 0xA0:
            return False
        kind = b[e[0][1] : e[0][2]]
        inner = _der(b, e[1][1], e[1][2])
        if inner is None:
            return False
        found = found or kind == _ENCRYPTED or (kind == _DATA and inner[0] == 0x04 and _holds_bag(b, inner[1], inner[2]))
    return found


def key_container(b: bytes) -> str:
    """The kind of private-key container that the bytes are by their grammar, or ''."""
    try:
        if b.startswith(b"openssh-key-v1\0"):
            return "openssh key" if _is_openssh(b) else ""
        if b[:4] in (b"\xfe\xed\xfe\xed", b"\xce\xce\xce\xce"):
            return "java key store" if _is_key_store(b) else ""
    except IndexError:
        return ""
    top = _der(b, 0, len(b))
    if top is None or top[0] != 0x30 or len(b) - top[2] > 2:
        return ""
    c = _children(b, top[1], top[2])
    if not c:
        return ""
    tags = [x[0] for x in c]
    first = int.from_bytes(b[c[0][1] : c[0][2]], "big") if tags[0] == 0x02 and c[0][2] - c[0][1] <= 2 else -1
    if first in (0, 1) and tags[1:] and all(t == 0x02 for t in tags[1:]) and len(tags) in (6, 9, 10):
        return "rsa or dsa private key"
    if first in (0, 1) and tags[1:3] == [0x30, 0x04]:
        return "pkcs8 private key"
    if first == 1 and tags[1:2] == [0x04] and all(t in (0xA0, 0xA1) for t in tags[2:]):
        return "ec private key"
    if first == 3 and tags[1:2] == [0x30] and tags[2:] in ([], [0x30]):
        return "pkcs12" if _is_pkcs12(b, c[1]) else ""
    if tags == [0x30, 0x04]:
        inner = _children(b, c[0][1], c[0][2])
        if inner and inner[0][0] == 0x06:
            return "encrypted private key"
    return ""


# --- layers ---


def _readable(raw: bytes) -> str | None:
    try:
        t = raw.decode("utf-8")
    except UnicodeDecodeError:
        return None
    return t if t and all(c.isprintable() or c in "\r\n\t" for c in t) else None


def _decoded(v: str) -> Iterator[tuple[str, bytes]]:
    """Single layers that ``v`` can be an encoding of."""
    if "\\" in v and _ESC.search(v):
        def one(m):
            s = m.group()
            if s[1] in "xu":
                return chr(int(s[2:].strip("{}"), 16))
            return {"n": "\n", "r": "\r", "t": "\t"}.get(s[1], s[1]) if len(s) == 2 else chr(int(s[1:], 8))

        try:
            yield "escape", _ESC.sub(one, v).encode("utf-8")
        except (ValueError, UnicodeEncodeError):
            pass
    if "%" in v and _PCT.search(v):
        yield "percent", urllib.parse.unquote_to_bytes(_CHAIN.sub("%", v))
    if _HEX.match(v):
        yield "hex", bytes.fromhex(v[2:] if v[:2] == "0x" else v)
    w = re.sub(r"\s+", "", v) if "\n" in v else v
    if _B64.match(w) and len(w.rstrip("=")) % 4 != 1:
        try:
            yield "base64", base64.b64decode(w.rstrip("=").replace("-", "+").replace("_", "/") + "=" * (-len(w.rstrip("=")) % 4), validate=True)
        except (binascii.Error, ValueError):
            pass


def _inside(v: str, kind: str) -> tuple[str, int] | None:
    """What the layers under ``v`` hold: (kind, layers), or None. ``kind`` is that of the name ``v`` belongs to. There is no limit to the
    layers: each decoding is shorter than what it was decoded from, so the work ends."""
    todo, seen = [(v, kind, 1)], {v}
    while todo:
        v, kind, depth = todo.pop()
        if len(v) < 12:
            continue
        for how, raw in _decoded(v):
            box = key_container(raw)
            if box:
                return box, depth
            t = _readable(raw)
            if t is None or t in seen:
                continue
            seen.add(t)
            for _ in _spots(t):
                return f"{how} layer", depth
            for m in _LITERAL.finditer(t):
                head, x = _head(t, m.start()), m.group(2)
                for _ in _plain(head, x, named := _named(head, len(x))):
                    return f"{how} layer", depth
                todo.append((x, named, depth + 1))
            t = t.strip()
            if kind and how != "hex" and _strong(t) and (how != "base64" or len(t) >= 8):
                return f"{how} layer", depth
            todo.append((t, kind, depth + 1))
    return None


def _spots(s: str, bare: bool = False) -> Iterator[tuple[int, int, str, int]]:
    """(start, end, kind, begin of the URL, header or token) of credentials that show by their surroundings or shape. In a ``bare`` line, outside of literals, a part of a
    connection string needs a separator before it."""
    if "-----BEGIN" in s:
        for m in _PEM.finditer(s):
            e = _PEM_END.search(s, m.end())
            body = s[m.end() : e.start() if e else len(s)]
            if MARK not in body and (len(re.sub(r"\\n|[\s\"'+`,;]", "", body)) >= 16 or not e):
                yield m.start(), e.end() if e else len(s), "private key", m.start()
    if "://" in s and "@" in s:
        for m in _URL.finditer(s):
            p = m.group(2)
            if p and not _PLACE.match(p) and not _PLACE.match(urllib.parse.unquote(p)):
                yield m.start(2), m.end(2), "url", m.start()
    for m in _KNOWN.finditer(s):
        if not _PLACE.match(m.group()):
            yield m.start(), m.end(), "token", m.start()
    for m in _ISSUED.finditer(s):
        r = m.group(1)
        if any(c.isdigit() for c in r) and any(c.isupper() for c in r) and any(c.islower() for c in r) and _entropy(r) > 3.4:
            yield m.start(), m.end(), "token", m.start()
    for rx, kind in ((_HEADER, "header"), (_PART, "connection string"), (_OPTION, "command")):
        for m in rx.finditer(s):
            g = 2 if rx is _PART else next(k for k in range(1, rx.groups + 1) if m.group(k) is not None)
            v = m.group(g)
            if bare and rx is _PART and (m.group()[0] not in ";?&" or "(" in v):
                continue
            if v[0] not in "<$[{" and (_strong(v) or (kind == "connection string" and v.endswith("==") and len(v) > 20)):
                yield m.start(g), m.end(g), kind, m.start()


def _named(head: str, length: int) -> str:
    """The kind of the name that ``head`` ends with, '' if there is none; ``length`` is that of its value."""
    n = _NAME.search(head)
    if not n or (head.rstrip().endswith(("(", ",")) and not re.search(r"[:=]\s*(?:\w+\s*)?\($", head.rstrip())):
        return ""
    return _name_kind(n.group(1), length)


def _plain(head: str, v: str, kind: str) -> Iterator[tuple[int, int, str, int, int]]:
    """(start, end, kind, layers, begin) of the findings of the value ``v``, of a name of ``kind``, without decoding it."""
    found = False
    for a, b, spot, begin in _spots(v):
        found = True
        yield a, b, spot, 0, begin
    if found or len(v) < 6 or not _strong(v):
        return
    if kind == "secret" or (kind and len(v) >= 8):
        yield 0, len(v), kind, 0, 0
    elif re.search(r"\d|[^\w.\-/]", v) and _LOGIN.search(head):
        yield 0, len(v), "login", 0, 0


def _judged(head: str, v: str) -> Iterator[tuple[int, int, str, int, int]]:
    """(start, end, kind, layers, begin) of the findings of the value ``v`` after ``head``: by its own content, by its layers, by the name before it."""
    kind = _named(head, len(v))
    found = list(_plain(head, v, kind))
    if len(v) >= 12 and (not found or found[0][2] in (kind, "login")) and (r := _inside(v, kind)):
        found = [(0, len(v), r[0], r[1], 0)]
    yield from found


def _head(s: str, at: int) -> str:
    """What stands before the literal at ``at`` in its line, or, if nothing does, in the line before: as much of it as a name can take."""
    a = s.rfind("\n", 0, at) + 1
    if a and not s[a:at].strip():
        a = s.rfind("\n", 0, a - 1) + 1
    n = 160
    while at - n > a and not _BREAK.search(s, at - n, at):
        n *= 2  # one long name or a wide gap
    return s[max(a, at - n) : at]


def _literal(s: str, m: re.Match) -> Iterator[tuple[int, int, str, int]]:
    """Findings of one string literal of ``s``."""
    at = m.start(2)
    for a, b, kind, layers, _ in _judged(_head(s, m.start()), m.group(2)):
        yield at + a, at + b, kind, layers


def _pieces(s: str, a: int, b: int) -> list[tuple[int, int]]:
    """The places of ``s[a:b]`` between escaped line ends."""
    out = []
    for m in _ESCAPED_END.finditer(s, a, b):
        out.append((a, m.start()))
        a = m.end()
    return [*out, (a, b)]


def _together(head: str, s: str, pieces: list[tuple[int, int]]) -> Iterator[tuple[int, str, int, tuple[tuple[int, int], ...]]]:
    """(begin, kind, layers, places) of the findings of the value that stands in several ``pieces`` of ``s``."""
    starts = [0]
    for x, y in pieces:
        starts.append(starts[-1] + y - x)
    for a, b, kind, layers, begin in _judged(head, "".join(s[x:y] for x, y in pieces)):
        parts = tuple((x + max(a - o, 0), x + min(b - o, y - x)) for (x, y), o in zip(pieces, starts) if max(a - o, 0) < min(b - o, y - x))
        first = next(x + begin - o for (x, y), o in zip(pieces, starts) if o <= begin < o + y - x)
        yield first, kind, layers, parts


def _joined(s: str, literals: list[re.Match]) -> Iterator[tuple[int, str, int, tuple[tuple[int, int], ...]]]:
    """Findings of the values that are put together from literals of ``s`` or go over escaped line ends."""
    k = 0
    while k < len(literals):
        first, pieces = literals[k], _pieces(s, *literals[k].span(2))
        while k + 1 < len(literals) and literals[k].group(3) and _GAP.fullmatch(s, literals[k].end(), literals[k + 1].start()):
            k += 1
            pieces += _pieces(s, *literals[k].span(2))
        k += 1
        if len(pieces) > 1:
            yield from _together(_head(s, first.start()), s, pieces)


def _lines(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """The places of what stands in the lines of ``text[a:b]``; [] if there is nothing or a line has several words."""
    lines = list(re.finditer(r"\S[^\n]*\S|\S", text[a:b]))
    return [] if any(re.search(r"\s", x.group()) for x in lines) else [(a + x.start(), a + x.end()) for x in lines]


def _blocks(text: str) -> Iterator[tuple[int, str, int, tuple[tuple[int, int], ...]]]:
    """Findings of named strings over several lines, here-documents and block scalars that hold one wrapped value, a piece a line."""
    done = -1
    for m in _BLOCK.finditer(text):
        end = text.find(m.group(1), m.end())
        if m.start() < done or end < 0:
            continue
        lines = _lines(text, m.end(), end)
        if not lines:
            continue
        done = end
        yield from _together(_head(text, m.start(1)), text, lines)
    for m in _HERE.finditer(text) if "<<" in text else ():
        e = re.compile(rf"(?m)^[ \t]*{m.group(2)}\b").search(text, m.end())
        if e and (lines := _lines(text, m.end(), e.start())):
            yield from _together(m.group(1) + " = ", text, lines)
    for m in _SCALAR.finditer(text) if "|\n" in text or ">\n" in text or "|\r" in text or "|-" in text or ">-" in text else ():
        e = re.compile(rf"(?m)^(?!{m.group(1)}[ \t]|[ \t]*\r?$)").search(text, m.end())
        if lines := _lines(text, m.end(), e.start() if e else len(text)):
            yield from _together(m.group(2) + " = ", text, lines)


def _key_blocks(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the private keys in ``text``, to the end of its base64 lines where the end mark is missing."""
    begins = list(_PEM.finditer(text)) if "-----BEGIN" in text else []
    for k, p in enumerate(begins):
        e = _PEM_END.search(text, p.end(), begins[k + 1].start() if k + 1 < len(begins) else len(text))
        end = e.end() if e else 0
        body = re.sub(r"\\n|-----[A-Z0-9 ]*-----|[\s\"'+`,;\\]", "", text[p.start() : end])
        # an end mark far away, behind other text, is not that of this key
        if e and "\n" in text[p.end() : e.start()] and 2 * sum(map(len, _RUN.findall(text, p.end(), e.start()))) < len(body):
            e = None
        if not e:
            end = _PEM_LINES.match(text, p.end()).end()
            body = re.sub(r"\\n|-----[A-Z0-9 ]*-----|[\s\"'+`,;\\]", "", text[p.start() : end])
        if len(body) >= 16 and not _PLACE.match(body) and "..." not in body:
            yield p.start(), end


def _hidden(text: str, start: int, end: int) -> str:
    """``text`` with blanks for ``text[start:end]``, but for quotes and line ends."""
    return text[:start] + re.sub(r"(\\[\"'`])|[^\s\"'`]", lambda m: m.group(1) or " ", text[start:end]) + text[end:]


def _triggers(text: str) -> list[int]:
    """Places that lines worth looking at hold, in order."""
    low = text.lower()
    if len(low) != len(text):  # a letter whose small form is longer
        low = "".join(x if len(x := c.lower()) == 1 else c for c in text)
    at = [m.start() for m in _MARKS.finditer(low)]
    at += [m.start() for m in _LONG.finditer(text)]
    at += [m.start() for m in _ADDED.finditer(text)]
    return at


def scan(text: str) -> list[Finding]:
    """Findings in ``text``, by position. A value over several lines is at the line where it begins."""
    out: list[Finding] = []
    done = -1
    line_no, at = 1, 0
    soft = [m for rx in _SOFT for m in rx.finditer(text)] if "\n" in text else []
    goes_on = [m.start() for m in soft]
    soft = {m.start(1) for m in soft}
    blocks: list[Finding] = []
    for f, kind, layers, p in _blocks(text):
        if not any(p[0][0] < x.end and x.start < p[-1][1] for x in blocks):
            blocks.append(Finding(p[0][0], p[-1][1], text.count("\n", 0, f) + 1, kind, layers, p))
    blocks += [Finding(x, y, text.count("\n", 0, x) + 1, "private key", 0) for x, y in _key_blocks(text) if not any(x < f.end and f.start < y for f in blocks)]
    for f in blocks:
        # judged as a whole; what stands before and after it is looked at as any text
        text = _hidden(text, f.start, f.end)
    for t in sorted(_triggers(text) + goes_on):
        if t < done:
            continue
        a = text.rfind("\n", 0, t) + 1
        b = text.find("\n", t)
        b = len(text) if b < 0 else b
        while a - 1 in soft:
            a = text.rfind("\n", 0, a - 1) + 1
        while b in soft:
            b = text.find("\n", b + 1)
            b = len(text) if b < 0 else b
        line_no += text.count("\n", at, a)
        at, done = a, b + 1
        s = text[a:b]
        literals = list(_LITERAL.finditer(s))
        found: dict[tuple[int, int], Finding] = {}

        def add(x: int, y: int, kind: str, layers: int, begin: int, parts: tuple[tuple[int, int], ...] = ()) -> bool:
            if new := not any(x < q and p < y for p, q in found):
                found[x, y] = Finding(a + x, a + y, line_no + s.count("\n", 0, begin), kind, layers, tuple((a + p, a + q) for p, q in parts))
            return new

        for begin, kind, layers, parts in _joined(s, literals):
            add(parts[0][0], parts[-1][1], kind, layers, begin, parts)
        for m in literals:
            for x, y, kind, layers in _literal(s, m):
                add(x, y, kind, layers, x)
        quoted = [m.span() for m in literals]
        low = 0
        for line in s.split("\n"):
            _unquoted(line, low, quoted, add)
            low += len(line) + 1
        out += sorted(found.values())
    return sorted(out + blocks)


def _unquoted(s: str, low: int, quoted: list[tuple[int, int]], add) -> None:
    """Adds what the physical line ``s``, at ``low``, holds outside of literals; what overlaps earlier findings is not added."""
    for x, y, kind, _ in _spots(s, True):
        add(low + x, low + y, kind, 0, low + x)
    for m in _BARE.finditer(s):
        v = m.group(2).rstrip(",;.)")
        x = low + m.start(2)
        if any(p <= x < q for p, q in quoted) or "(" in v or not _name_kind(m.group(1)):
            continue
        if _strong(v) and re.search(r"\d", v) and (re.search(r"[^\w.]", v) or _entropy(v) > 3.3) and not re.fullmatch(r"[a-z]+(?:[_.][a-z0-9]+)*|[a-z]+(?:[A-Z][a-z0-9]+)*", v):
            add(x, x + len(v), "assignment", 0, x)
        elif r := _inside(v, "secret"):
            add(x, x + len(v), *r, x)
    spoken = [m.end() for m in _SPOKEN.finditer(s)]
    if not spoken:
        return
    stops, last = [m.start() for m in _STOP.finditer(s)], -1
    for m in _SAID.finditer(s):
        k = bisect_right(spoken, m.start()) - 1
        # the word and what says its value stand in one run of words, and the first such value is the word's
        if k <= last or bisect_left(stops, spoken[k]) < bisect_left(stops, m.start()):
            continue
        last = k
        v = m.group(1).rstrip(",;.)")
        if _strong(v) and re.search(r"\d|[^\w.]", v) and "(" not in v:
            add(low + m.start(1), low + m.start(1) + len(v), "note", 0, low + m.start(1))
    if _COMMENT.match(s):
        for m in _VALUE.finditer(s, spoken[0]):
            v = m.group().rstrip(",;.)")
            mixed = bool(re.search(r"\d", v)) and bool(re.search(r"[A-Za-z]", v)) and "(" not in v
            if mixed and _strong(v) and _entropy(v) > 2.8 and (re.search(r"[^\w./\-]", v) or re.fullmatch(r"[0-9a-f]{32,}", v) or (len(v) >= 16 and re.search(r"[A-Z].*[a-z]|[a-z].*[A-Z]", v) and not re.fullmatch(r"(?:[a-z]+|[A-Z][a-z]+)(?:[A-Z][a-z]+|_[a-z]+)*\d{0,4}", v))):
                x = low + m.start()
                add(x, x + len(v), "note", 0, x)


def redact(text: str, findings: list[Finding] | None = None) -> str:
    """``text`` with each value replaced by a mark; inside a private key block, line ends and quotes stay
    and its begin and end marks no longer name a key."""
    out, at = [], 0
    for f in sorted(findings if findings is not None else scan(text)):
        if f.start < at:
            continue
        if f.parts:
            for k, (x, y) in enumerate(f.parts):
                out += [text[at:x], "" if k else MARK]
                at = y
            continue
        v = text[f.start : f.end]
        out += [text[at : f.start], _PEM_SECRET.sub(lambda m: f"-----{m.group(1)} {MARK}-----" if m.group(1) else m.group(2) or MARK, v) if "-----BEGIN" in v else MARK]
        at = f.end
    return "".join([*out, text[at:]])


def _scanner(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for i, t in zip(b["id"], b["content"]):
            out += [(i, f.line_no, f.start, f.end, f.kind, f.layers) for f in scan(t)]
        yield pd.DataFrame(out, columns=["id", "line_no", "start", "end", "kind", "layers"])


def _redactor(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        found = [scan(t) for t in b["content"]]
        yield pd.DataFrame({"id": b["id"], "content": [redact(t, f) for t, f in zip(b["content"], found)], "n_findings": [len(f) for f in found]})


def _texts(df: DataFrame, id_col: str, text: str) -> DataFrame:
    return spread(df.filter(F.col(id_col).isNotNull() & (F.length(F.col(text)) > 0)).select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("content")), "id")


def find_credentials(df: DataFrame, id_col: str = "id", text: str = "content") -> DataFrame:
    """(id, line_no, start, end, kind, layers), start and end in characters of the text, line_no from 1.

    Without a shuffle: NULL or empty texts and NULL ids have no rows, a text delivered twice has its findings twice (the
    query on top makes them distinct), extra columns are ignored."""
    return _texts(df, id_col, text).mapInPandas(_scanner, "id long, line_no long, start long, end long, kind string, layers int")


def redact_credentials(df: DataFrame, id_col: str = "id", text: str = "content") -> DataFrame:
    """(id, content, n_findings): all texts with their credentials replaced. NULL or empty texts have no rows."""
    return _texts(df, id_col, text).mapInPandas(_redactor, "id long, content string, n_findings long")
