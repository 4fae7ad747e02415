"""Credentials embedded in code, configuration and talk: where they are, and the text without them.

How a literal is judged
    Every literal (quoted string, right side of an assignment, part of a link, lone word) is cut into
    dictionary words by a Viterbi search over word costs; what no word explains is its *residual*. A literal
    becomes a credential if its residual is long enough for the strength of the context around it: a few
    characters next to a password name, many next to a key or token name, a vendor's own format anywhere.
    Digest formats (hexadecimal of the usual lengths, UUIDs, base64 digests) are excluded unless the name
    itself says that the value is a secret. References to values kept elsewhere, placeholders, masked and
    cut-off values, public keys and certificates are excluded.

Defined cases
    Null and empty texts have no credential and stay as they are. A private key runs from its BEGIN line to
    its END line, or to the end of the text when that is missing. Of two spans that overlap the earlier, and
    of those the longer, is kept. Repeated rows are judged once per batch. Extra columns are carried along;
    a column with the name of an output is replaced.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.sources.ship import local_file, ship_file

#: Vocabulary file, on the driver, of the public tokenizer whose whole words serve as dictionary.
VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"


def dictionary(path: str = VOCABULARY) -> dict[str, float]:
    """Whole words of a tokenizer's vocabulary with their cost in nats, by Zipf's law over the rank."""
    with open(local_file(path), encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    words = [w[:-4] for w, _ in sorted(vocab.items(), key=lambda x: x[1]) if w.endswith("</w>") and w[:-4].isalpha() and len(w) >= 8]
    return {w: math.log(rank + 10.0) + 1.0 for rank, w in enumerate(words)}


class Segmenter:
    """Viterbi segmentation of a literal into dictionary words and unexplained characters."""

    #: cost of one unexplained character, and of one more once in a run
    UNKNOWN = 4.2

    def __init__(self, words: dict[str, float]):
        self.words = words
        self.longest = min(20, max(map(len, words), default=1))
        self.residual = lru_cache(200_000)(self._residual)

    def _residual(self, literal: str) -> int:
        """How many letters and digits no dictionary word explains."""
        return sum(self._run(x) for x in re.findall(r"[^\W\d_]+|\d+", _humps(literal)))

    def _run(self, run: str) -> int:
        if run.isdigit():
            return len(run)
        low, n = run.lower(), len(run)
        best = [0.0] + [math.inf] * n
        left = [0] * (n + 1)
        for j in range(1, n + 1):
            best[j], left[j] = best[j - 1] + self.UNKNOWN, left[j - 1] + 1
            for i in range(max(0, j - self.longest), j - 3):
                cost = self.words.get(low[i:j])
                if cost is not None and best[i] + cost < best[j]:
                    best[j], left[j] = best[i] + cost, left[i]
        return left[n]


def _humps(s: str) -> str:
    """camelCase with a space at each hump; runs of mixed case are left alone."""
    return re.sub(r"(?<=[a-z]{3})(?=[A-Z][a-z]{2})", " ", s)


# ------------------------------------------------------------------------------------------------ formats
# Formats that vendors document for their keys.
VENDOR = re.compile(
    r"(?<![A-Za-z0-9])(?:gh[pousr]_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{40,}|glpat-[\w-]{20,}|(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])"
    r"|xox[abeoprs]-[\w-]{20,}|(?:sk|rk)_(?:live|test)_[A-Za-z0-9]{16,}|sk-[A-Za-z0-9_-]{32,}|AIza[\w-]{33,35}(?![\w-])|SG\.[\w-]{16,}\.[\w-]{16,}|npm_[A-Za-z0-9]{30,}"
    r"|pypi-[\w-]{40,}|dop_v1_[0-9a-f]{60,}|hf_[A-Za-z0-9]{30,}|SK[0-9a-f]{32}(?![0-9a-f])|ya29\.[\w-]{20,}|eyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{8,}"
    r"|https?://hooks\.[\w.-]+/services/[A-Z0-9]+/[A-Z0-9]+/\w{12,})"
)
PRIVATE = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
PRIVATE_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
PUBLIC = re.compile(r"-----BEGIN (?!(?:[A-Z0-9]+ )*PRIVATE)[A-Z0-9 ]+-----[\s\S]*?(?:-----END [A-Z0-9 ]+-----|\Z)")
USERINFO = re.compile(r"\b[a-zA-Z][\w+.-]{1,20}://([^\s/@:'\"<>]*):([^\s/@'\"]+)@[\w.\[-]+")
LINK_TOKEN = re.compile(r"\b[a-zA-Z][\w+.-]{1,20}://([^\s/@:'\"<>{}$]{12,})@[\w.-]+")
BASIC = re.compile(r"(?i)\bauthorization['\"]?\s*[:=]\s*['\"]?basic\s+([A-Za-z0-9+/=_-]{8,})")
BEARER = re.compile(r"(?i)\b(?:bearer|authorization['\"]?\s*[:=]\s*['\"]?(?:token|bearer))\s+([A-Za-z0-9+/=_.~-]{12,})")
CURL_USER = re.compile(r"(?:\bcurl\b|\bwget\b|\bhttp\b).*?\s(?:-u|--user)\s*['\"]?[^\s:'\"]+:([^\s'\"]+)")
DASH_P = re.compile(r"\b(?:sshpass|mysql|mysqldump|redis-cli|psql|mongo|ldapsearch|smbclient)\b.*?\s(?:-p|-a|-w|--password[= ])\s*['\"]?([^\s'\"]{6,})")
SETTER = re.compile(r"(?i)\b(?:\w*\.)?set_?(?:password|passwd|pwd|secret|token|api_?key|passphrase)\(\s*(['\"`])(.+?)\1")
ASSIGN = re.compile(r"(?P<key>[^\W\d][\w.\-]*)[\"'\]]*\s*(?P<op>:=|=>|->|=|:(?!//))\s*(?P<val>\"\"\"|\"[^\"\n]*\"(?:\s*\+\s*\"[^\"\n]*\")*|'[^'\n]*'(?:\s*\+\s*'[^'\n]*')*|`[^`\n]*`|[^\s\"'`,;<>(){}\[\]&]+)")
SPACED = re.compile(r"(?i)\b(?P<key>\w*(?:password|passwd|passphrase|secret|token|api_?key)|pass)\s+(?P<val>[^\s\"'`,;<>(){}\[\]=:]{7,})")

# Names that say what a value is, in the languages of the data.
PASSWORD_NAME = re.compile(r"(?i)(?:pass(?:word|wort|wd|phrase|e)?|(?<![a-z])pw|pwd|kennwort|contrase[nñ]a|clave|mot[_ -]de[_ -]passe)$")
SECRET_NAME = re.compile(r"(?i)(?:secret|token|(?:api|access|account|private|signing|subscription|encryption|master|shared|client|service|auth|app|google|stripe|azure|aws|secret)[_.-]?(?:access[_.-]?)?key|(?<![a-z])key|credentials?|authtoken|(?<![a-z])auth|bearer|webhook|bot|signature|(?<![a-z])sig|(?<![a-z])sk|hash_?salt|pepper)$")
NOT_SECRET_NAME = re.compile(r"(?i)(?:public|cache|primary|foreign|sort|partition|idempotency|next|page|etag|sha\d*|md5|checksum|digest|integrity|trace|request|commit|min|max|color|csrf_?name|token_type)")
TALK = re.compile(
    r"(?i)(?<![a-z])(?:pass(?:word|wort|wd|code|phrase)?s?|pw|pwd|kennwort|contraseñas?|claves?|mot de passe|secret|geheimnis|secreto|token|jeton|api[ -]?key|key|schlüssel|clé|llave|login|log in|bearer|credentials?|zugangsdaten|pin)(?![a-z])"
)
TALK_PASSWORD = re.compile(r"(?i)(?<![a-z])(?:pass(?:word|wort|wd|code|phrase)?|pw|pwd|kennwort|contraseña|clave|mot de passe|login|log in|zugangsdaten|pin/pw)(?![a-z])")
#: words and signs right before a password that is told
STATED = re.compile(r"(?:[:>/=]|\b(?:lautet|ist|es|is|to|pass|est|son))\s+[\"'`]?$", re.I)
DIGEST_TALK = re.compile(r"(?i)\b(?:sha-?\d*|md5(?:sum)?|etag|digest|checksum|integrity|commit|trace-?id|x-request-id|request-id|fingerprint|revision|build|docker|ssh-(?:rsa|ed25519|dss)|ecdsa-sha2\S*|data:image|public[_ -]?key|uuid|guid)\b|^\s*id\b")
PLACEHOLDER = re.compile(r"(?i)(?:x{5,}|\*{3,}|\.{3,}|…|_{4,}|0{8,}|(?<![a-z0-9])(?:your|my|the|some|insert|replace|change)[_ -]|redacted|(?<![a-z0-9])(?:masked|placeholder|dummy|todo)(?![a-z0-9])|example[_-]?(?:key|token|secret)|EXAMPLE$|<[^>]*>|\[[^\]]*\]|\{[^}]*\}|\$[A-Za-z_{(]|%[A-Za-z_]+%)")
REFERENCE = re.compile(r"(?i)^(?:(?:os|process|sys|env|config|settings|secrets?|vault|self|this|ctx|ctrl|data|app|params?|request|getpass|random|crypto|jwt|ENV)[.\[(]|\w+\(|[\w.]+\[|/|\./|~/|file:|env:|vault:|arn:|kv/|none$|null$|nil$|true$|false$|undefined$|str$|string$|int$|bytes$|https?://[^?&]*$)")
#: formats of digests and ids
HASH_FORMS = "[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{48}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}|[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
HASH = re.compile(rf"(?i)^(?:{HASH_FORMS})$")
DIGEST = re.compile(r"^(?:sha\d+[-:]|md5[-:])")
#: a text or line without any of these, in lower case, and without a match of SHORT, holds nothing that is looked for
SIGNS = (
    # names and words of talk
    "pass", "pw", "contrase", "clave", "kennwort", "secret", "token", "key", "schlüssel", "clé", "login", "log in", "auth", "bearer", "private", "credential", "webhook", "sid=", "session",
    "signature", "hash_salt", "hashsalt", "pepper", "zugangsdaten", "geheimnis", "jeton", "llave",
    # links, and commands with their options
    "://", "-u", "-p ", "mysql", "redis-cli", "psql", "mongo", "ldapsearch", "smbclient",
    # formats of vendors
    "akia", "asia", "eyj", "xox", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "sg.", "aiza", "npm_", "k_live_", "k_test_", "sk-", "pypi-", "dop_v1", "hf_", "ya29.",
)
#: signs that are part of many words, with what must stand around them; one of SHORT_IN is in each
SHORT = re.compile(r"(?<![a-z])pin(?![a-z])|(?:bot|(?<![a-z])sk|(?<![a-z])sig)[\"'\]]*\s*(?:->|[:=])|(?<![a-z0-9])sk[0-9a-f]{32}|\s--user")
SHORT_IN = ("pin", "bot", "sk", "sig", "--user")
#: a long literal behind a name that doesn't say what it is
UNNAMED = re.compile(r"[:=>]\s*[\"'`]?[^\s\"'`,;<>(){}\[\]&]{20}")


def _gate(text: str) -> bool:
    low = text.lower()
    return any(x in low for x in SIGNS) or any(x in low for x in SHORT_IN) and bool(SHORT.search(low)) or bool(UNNAMED.search(text))


class Detector:
    """Finds credentials in texts; holds the dictionary and a cache of judged literals."""

    #: residuals from which a literal counts, by strength of its context
    PASSWORD_RESIDUAL, SECRET_RESIDUAL, TALK_RESIDUAL, LONE_RESIDUAL, UNNAMED_RESIDUAL = 2, 12, 12, 14, 20
    #: longer literals without a telling name are data of some kind
    LONGEST_UNNAMED = 200

    def __init__(self, words: dict[str, float]):
        self.seg = Segmenter(words)

    # ---- judging one literal
    def is_value(self, v: str) -> bool:
        """Neither a placeholder, a reference, a number, an address nor prose."""
        if v.startswith("/") and re.fullmatch(r"[A-Za-z0-9+/]{30,}={0,2}", v) and (self.seg.residual(v) >= len(v) * 0.5 or self.irregular(v)):
            return True  # base64 may begin like a path
        return not (len(v) < 6 or " " in v.strip() or PLACEHOLDER.search(v) or REFERENCE.search(v) or re.fullmatch(r"[\d.,:/+-]+", v) or len(set(v)) < 4)

    @staticmethod
    def irregular(v: str) -> bool:
        """Case changes that no word and no camelCase has."""
        return len(re.findall(r"[a-z][A-Z]|[A-Z]{2}[a-z]|[a-z][A-Z][A-Z]|[A-Z][a-z][A-Z]", v)) >= 3

    def password(self, v: str) -> bool:
        if not self.is_value(v) or len(v) < 7 or DIGEST.match(v):
            return False
        letters, digits, other = sum(c.isalpha() for c in v), sum(c.isdigit() for c in v), sum(not c.isalnum() for c in v)
        if digits and letters:
            return self.seg.residual(v) >= self.PASSWORD_RESIDUAL
        return self.seg.residual(v) >= (5 if self.irregular(v) else 7) or bool(letters and other >= 1 and re.search(r"[!#$%&*?^]", v))

    def secret(self, v: str, least: int | None = None) -> bool:
        if not self.is_value(v) or DIGEST.match(v):
            return False
        least = least or self.SECRET_RESIDUAL
        return len(v) >= 12 and self.seg.residual(v) >= (least / 2 if self.irregular(v) else least)

    def unnamed(self, v: str) -> bool:
        """A literal whose name doesn't say what it is: only its residual speaks for it."""
        return 20 <= len(v) <= self.LONGEST_UNNAMED and self.is_value(v) and not DIGEST.match(v) and not HASH.match(v) and self.seg.residual(v) >= self.UNNAMED_RESIDUAL

    def encoded(self, v: str) -> bool:
        """Base64 that decodes to printable text of a password's shape."""
        import base64

        try:
            t = base64.b64decode(v + "=" * (-len(v) % 4), validate=True).decode("ascii")
        except ValueError:
            return False
        return len(t) >= 7 and t.isprintable() and " " not in t and (not t.isalpha() or self.irregular(t))

    def lone(self, v: str) -> bool:
        """A literal that stands alone as a text: already cut out by some validator."""
        if not self.is_value(v) or "@" in v or len(v) < 9 or re.search(r"[\"'<>()]|^data:", v):
            return False
        if HASH.match(v):
            return False  # nothing says that it is more than a digest or an id
        if self.encoded(v):
            return True
        if re.search(r"\d", v) and re.search(r"[a-z]", v):
            return self.seg.residual(v) >= self.PASSWORD_RESIDUAL and not re.search(r"[/\\:.]", v) or self.seg.residual(v) >= self.LONE_RESIDUAL
        return self.seg.residual(v) >= (5 if self.irregular(v) else 7 if re.search(r"[!#$%&*?^]", v) else 16)

    def material(self, body: str) -> bool:
        """Whether a key stands between the BEGIN line and the END line, or the end of the text."""
        if re.search(r"[A-Za-z0-9+/=]{16}", body[:400]):
            return True
        # further on, a long word or a path is no key
        if any(self.seg.residual(x) >= 8 and len(set(x)) >= 6 for x in re.findall(r"[A-Za-z0-9+/=]{16,}", body[400:])):
            return True
        # pieces of fewer characters: lines or quoted strings of nothing else
        pieces = "".join(re.findall(r"(?m)^[ \t]*[\"'`]?([A-Za-z0-9+/=]+)(?:\\n)?[\"'`]?[ \t,+;\\]*$", body))
        return len(pieces) >= 32 and self.seg.residual(pieces) >= 16 and bool(re.search(r"\d", pieces) and re.search(r"[a-z]", pieces) and re.search(r"[A-Z]", pieces))

    # ---- one text
    def spans(self, text: str, alone: bool = False) -> list[tuple[int, int, str]]:
        """(start, end, kind) of the credentials of ``text``, in order, not overlapping.

        ``alone``: the text is itself a match cut out elsewhere, perhaps with a label in front.
        """
        if not text or not alone and not _gate(text):
            return []
        out: list[tuple[int, int, str]] = []
        shut: list[tuple[int, int]] = [m.span() for m in PUBLIC.finditer(text)]
        for m in PRIVATE.finditer(text):
            end = PRIVATE_END.search(text, m.end())
            if not self.material(text[m.end() : end.start() if end else len(text)]):
                continue  # only the header is named
            out.append((m.start(), end.end() if end else len(text), "PRIVATE_KEY"))
            shut.append(out[-1][:2])
        free = lambda a: not any(x <= a < y for x, y in shut)
        for m in VENDOR.finditer(text):
            if free(m.start()) and not PLACEHOLDER.search(m[0].replace("test_", "")) and not text.startswith("...", m.end()) and (self.seg.residual(m[0]) >= 5 or m[0].startswith(("AKIA", "ASIA")) and re.search(r"\d", m[0])):
                out.append((*m.span(), "VENDOR_KEY"))
        at = 0
        lines = text.split("\n")
        pending = ""
        for line in lines:
            if line.strip() and (pending or alone or _gate(line)) and free(at):
                found, pending = self._line(line, pending)
                out += [(at + a, at + b, k) for a, b, k in found if free(at + a)]
            elif line.strip():
                pending = ""
            at += len(line) + 1
        if alone and not out and "\n" not in text.strip():
            s = text.strip()
            i = text.index(s) if s else 0
            joined = re.sub(r"[\"']\s*\+\s*[\"']", "", s)
            label = re.match(r"([\w.-]+)\s*[:=]\s*(?=\S)", joined)
            if label and (PASSWORD_NAME.search(label[1]) or SECRET_NAME.search(label[1])) and not NOT_SECRET_NAME.search(label[1]):
                joined, cut = joined[label.end() :], label.end()
                if self.lone(joined) or self.password(joined) and not re.search(r"[\"'()]", joined):
                    out.append((i + cut, i + len(s), "SECRET"))
            elif s and self.lone(joined):
                out.append((i, i + len(s), "SECRET"))
        out.sort(key=lambda x: (x[0], -x[1]))
        kept: list[tuple[int, int, str]] = []
        for x in out:
            if not kept or x[0] >= kept[-1][1]:
                kept.append(x)
        return kept

    def _line(self, line: str, pending: str) -> tuple[list[tuple[int, int, str]], str]:
        """Credentials of one line, and the name that waits for a value on the next line."""
        out = []
        stripped = line.strip()
        if pending:
            v = stripped.strip("\"'`")
            if (self.password if pending == "PASSWORD" else self.secret)(v) and not re.match(r"[\w.-]+\s*[:=]\s", stripped):
                i = line.index(v)
                return [(i, i + len(v), pending)], ""
        for m in USERINFO.finditer(line):
            if self.is_value(m[2]) and (not m[2].isalpha() or self.seg.residual(m[2]) >= 5):
                out.append((*m.span(2), "CONNECTION"))
        for m in LINK_TOKEN.finditer(line):
            if self.secret(m[1]):
                out.append((*m.span(1), "TOKEN"))
        for rule, group, judge, kind in ((BASIC, 1, self.encoded, "BASIC_AUTH"), (BEARER, 1, self.secret, "TOKEN"), (CURL_USER, 1, self.password, "PASSWORD"), (DASH_P, 1, self.password, "PASSWORD"), (SETTER, 2, self.password, "PASSWORD")):
            out += [(*m.span(group), kind) for m in rule.finditer(line) if judge(m[group])]
        waits = ""
        for m in ASSIGN.finditer(line):
            key, raw = m["key"], m["val"]
            password = PASSWORD_NAME.search(key)
            if NOT_SECRET_NAME.search(key):
                continue
            if not password and not SECRET_NAME.search(key):
                v = raw.strip("\"'`")
                if self.unnamed(v) and not DIGEST_TALK.search(line):
                    out.append((i := m.start("val") + (raw[:1] in "\"'`"), i + len(v), "SECRET"))
                continue
            if raw in ("|", ">", ">-", "|-", '"""', "'''"):
                waits = "PASSWORD" if password else "SECRET"
                continue
            v = re.sub(r"[\"']\s*\+\s*[\"']", "", raw).strip("\"'`")
            i = m.start("val") + (raw[:1] in "\"'`")
            nested = ASSIGN.match(line, m.start("val"))
            if nested and nested.end() > m.end():  # label: name = value
                continue
            if line[m.end() : m.end() + 1] in "([{<" and line[m.end() : m.end() + 1]:
                continue  # a call or an index
            if raw[:1] not in "\"'`" and line[m.end() : m.end() + 1] == "&" and password:
                v = re.match(r"[^\s\"';,]+", line[m.start("val") :])[0]  # & may belong to a password
            if (self.password(v) if password else self.secret(v)) or len(v) >= 12 and self.encoded(v):
                out.append((i, i + max(len(v), len(raw) - 2 * (raw[:1] in "\"'`")), "PASSWORD" if password else "SECRET"))
        if re.search(r"(?:[:=]\s*(?:[|>]-?|\"\"\"|''')|<<\s*\w+)\s*$", line) and not waits:
            k = re.match(r"\s*[\"']?([\w.-]+)[\"']?\s*[:=]", line)
            if k and not NOT_SECRET_NAME.search(k[1]):
                waits = "PASSWORD" if PASSWORD_NAME.search(k[1]) else "SECRET" if SECRET_NAME.search(k[1]) else ""
        for m in SPACED.finditer(line):
            v = m["val"]
            if re.search(r"\d", v) and (self.password(v) if PASSWORD_NAME.search(m["key"]) else self.secret(v)):
                out.append((*m.span("val"), "PASSWORD"))
        if not out and TALK.search(line) and not DIGEST_TALK.search(line):
            hint = bool(TALK_PASSWORD.search(line))
            for m in re.finditer(r"[^\s\"'`,;<>(){}\[\]=]{8,}", line):
                v = m[0].rstrip(".:)") if not m[0].endswith("...") else ""
                stated = hint and (self.irregular(v) or re.fullmatch(r"[a-z]{7,}[!#$%&*?]", v) and STATED.search(line[: m.start()]))
                if not re.search(r"\d", v) and not stated or not re.search(r"[A-Za-z]", v) or "://" in v or re.search(r"@|\\|\w\.\w+\.|^[\w-]+\.[a-z]{2,5}$", v):
                    continue
                if re.search(r"[a-z]", v) and (hint and self.password(v) or self.secret(v, self.TALK_RESIDUAL)):
                    out.append((m.start(), m.start() + len(v), "PASSWORD" if hint else "SECRET"))
        return out, waits

    def redact(self, text: str, alone: bool = False, spans: list[tuple[int, int, str]] | None = None) -> str:
        """``text`` with each credential (those of ``spans``, if given) replaced by a placeholder; quotes, names and line ends stay."""
        parts, last = [], 0
        for a, b, kind in self.spans(text, alone) if spans is None else spans:
            body = text[a:b]
            # lines of a key keep their number, so that line numbers of the code after it don't move
            parts += [text[last:a], f"[REDACTED-{kind.replace('_', '-')}]" + "\n" * body.count("\n")]
            last = b
        return "".join(parts) + text[last:]


_DETECTORS: dict[str, Detector] = {}


def detector(path: str = VOCABULARY) -> Detector:
    """One detector per process and vocabulary."""
    if path not in _DETECTORS:
        _DETECTORS[path] = Detector(dictionary(path))
    return _DETECTORS[path]


SPAN = "array<struct<start:int,length:int,line_no:int,kind:string>>"


def _structs(text: str, spans: list[tuple[int, int, str]]) -> list[dict]:
    return [{"start": a, "length": b - a, "line_no": text.count("\n", 0, a) + 1, "kind": k} for a, b, k in spans]


def found(alone: bool = False, path: str = VOCABULARY):
    """A Column function: the credentials of a text column as an array of spans (code points from 0)."""
    ship_file(path)

    @F.pandas_udf(SPAN)
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        d = detector(path)
        for s in batches:
            codes, values = pd.factorize(s)
            rows = [_structs(v, d.spans(v, alone)) for v in values]
            yield pd.Series([rows[c] if c >= 0 else [] for c in codes], index=s.index)

    return apply


def redacted(alone: bool = False, path: str = VOCABULARY):
    """A Column function: the text with its credentials replaced by placeholders; null stays null."""
    ship_file(path)

    @F.pandas_udf("string")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        d = detector(path)
        for s in batches:
            codes, values = pd.factorize(s)
            done = [d.redact(v, alone) for v in values]
            yield pd.Series([done[c] if c >= 0 else None for c in codes], index=s.index, dtype=object)

    return apply


def redacted_with_spans(alone: bool = False, path: str = VOCABULARY):
    """A Column function: ``struct<redacted, spans>`` of a text column, by one search."""
    ship_file(path)

    @F.pandas_udf(f"struct<redacted:string,spans:{SPAN}>")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        d = detector(path)
        for s in batches:
            codes, values = pd.factorize(s)
            got = [d.spans(v, alone) for v in values]
            done = [(d.redact(v, alone, x), _structs(v, x)) for v, x in zip(values, got, strict=True)] + [(None, [])]  # code -1 is null
            yield pd.DataFrame([done[c] for c in codes], columns=["redacted", "spans"], index=s.index)

    return apply


def spans_of(df: DataFrame, id_col: str, column: str, alone: bool = False, path: str = VOCABULARY) -> DataFrame:
    """(rec_id, spans): the credentials of every text."""
    return df.select(F.col(id_col).alias("rec_id"), found(alone, path)(F.col(column)).alias("spans"))


def lines(spans: DataFrame, alone: bool = False) -> DataFrame:
    """(rec_id, line_no), distinct: the lines on which a credential begins; with ``alone`` always line 1."""
    # a text holds its lines once, so the distinct needs no shuffle; the outer form keeps the optimiser from
    # testing for empty arrays first, which would run the detector twice
    return spans.select("rec_id", F.explode_outer(F.array_distinct(F.transform("spans", lambda x: F.lit(1) if alone else x["line_no"]))).alias("line_no")).where("line_no is not null")


def credential_lines(df: DataFrame, id_col: str, column: str, alone: bool = False, path: str = VOCABULARY) -> DataFrame:
    """``lines`` of the texts of ``df``."""
    return lines(spans_of(df, id_col, column, alone, path), alone)


def named_in_text(matches: DataFrame, spans: DataFrame, id_col: str = "finding_id", text_id: str = "request_id", match: str = "match_text") -> DataFrame:
    """(rec_id), distinct: matches in the form of a digest or id which the text around them makes credentials.

    A match cut out of its text has lost the name in front of it. ``matches``: (``id_col``, ``text_id``,
    ``match``, match_position, match_length) with positions in the text; ``spans``: (rec_id, spans) of the
    texts, at most one row per text. A match is a credential if a credential of the text overlaps its place.
    Only ids and places are shuffled. Null places and texts that aren't there give nothing.
    """
    like = matches.where(F.trim(match).rlike(rf"(?i)^(?:{HASH_FORMS})$")).select(F.col(id_col).alias("m"), F.col(text_id).alias("rec_id"), F.col("match_position").alias("a"), (F.col("match_position") + F.col("match_length")).alias("b"))
    places = spans.select("rec_id", F.transform("spans", lambda x: F.struct(x["start"].alias("a"), (x["start"] + x["length"]).alias("b"))).alias("places")).where(F.size("places") > 0)
    both = like.join(places, "rec_id")
    return both.where(F.exists("places", lambda x: (x["a"] < F.col("b")) & (F.col("a") < x["b"]))).select(F.col("m").alias("rec_id"))
