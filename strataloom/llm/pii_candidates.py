"""Candidate spans of personal information, many and overlapping, and the features of each.

A generator says where something of a kind may stand; whether it does is for the classifier, which
sees the format of the span and the text around it. Spans begin and end with a letter or digit (phone
numbers may begin with + or an opening bracket).
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

KINDS = ("email", "phone", "id_number", "address", "name")

# ---- fixed values: words that mark a context, by language en, de, fr, es ----
TITLES = {"mr", "mrs", "ms", "miss", "dr", "prof", "herr", "frau", "monsieur", "madame", "mme", "mlle", "señor", "señora", "sr", "sra", "doctor", "doctora", "sir", "don", "doña"}
#: prepositions, labels of mail and package headers, and verbs that often stand before a person
LEADS = {
    "by", "from", "to", "with", "and", "cc", "bcc", "attn", "attention", "dear", "hello", "hi", "contact", "author", "authors", "owner", "reviewer", "maintainer", "editor", "sender", "recipient", "manager", "customer", "patient", "employee", "applicant", "name", "ask", "tell", "call", "met", "meet", "told", "asked", "called",
    "thanks", "thank", "regards", "sincerely", "signed", "written", "approved", "reported", "assigned", "interviewed", "colleague", "said", "via",
    "von", "an", "mit", "bei", "durch", "und", "hallo", "lieber", "liebe", "grüßen", "gruß", "grüße", "kollege", "kollegin", "autor", "autorin",
    "par", "avec", "chez", "à", "et", "cher", "chère", "bonjour", "cordialement", "auteur", "auprès", "por", "con", "para", "a", "y", "hola", "estimado", "estimada", "saludos", "autor", "autora", "atentamente",
}
ARTICLES = {"the", "a", "an", "this", "that", "der", "die", "das", "dem", "den", "ein", "eine", "le", "la", "les", "l", "un", "une", "el", "los", "las", "una"}
#: function words, and words of headings and greetings, that are capitalised without being a name
NO_NAMES = {
    "the", "this", "that", "these", "those", "and", "or", "but", "if", "in", "on", "at", "of", "for", "to", "from", "with", "without", "by", "as", "is", "are", "was", "were", "be", "it", "its", "we", "you", "he", "she", "they", "my", "your", "our", "their", "his", "her", "not", "no", "yes", "so", "then", "than", "there", "here",
    "what", "when", "where", "which", "who", "why", "how", "all", "any", "some", "each", "every", "both", "most", "more", "many", "few", "one", "two", "three", "after", "before", "during", "until", "since", "under", "over", "while", "because", "also", "only", "now", "please", "thanks", "thank", "dear", "hello", "hi",
    "mr", "mrs", "ms", "dr", "prof", "herr", "frau", "mme", "mlle", "sr", "sra", "regards", "best", "kind", "sincerely", "cordialement", "saludos", "atentamente", "subject", "date", "name", "names", "phone", "tel", "fax", "mobile", "email", "mail", "address", "contact", "author", "reviewer", "maintainer", "owner", "signed",
    "let", "see", "call", "ask", "note", "todo", "info", "warning", "error", "debug", "fixed", "added", "removed", "changed", "updated", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday",
    "january", "february", "march", "april", "june", "july", "august", "september", "october", "november", "december",
    "der", "die", "das", "den", "dem", "ein", "eine", "und", "oder", "von", "mit", "für", "bei", "nach", "vor", "seit", "ist", "sind", "war", "nicht", "wir", "sie", "es", "im", "am", "zum", "zur", "bitte", "danke", "wenn", "dann", "noch", "nur", "auch", "alle", "jede", "jeder",
    "le", "la", "les", "et", "ou", "de", "du", "des", "un", "une", "avec", "pour", "par", "sur", "dans", "est", "sont", "nous", "vous", "il", "elle", "ne", "pas", "ce", "cette", "voir", "merci", "si", "el", "los", "las", "y", "o", "con", "para", "por", "en", "del", "que", "una", "es", "son", "no", "se", "su", "al", "gracias",
}
ID_LABELS = re.compile(r"(?i)\b(?:ssn|social security|national id|identity|identity number|id no|id number|passport|tax id|taxpayer|ni number|insurance|steuer|steuernummer|pass-?nr|reisepass|ausweis\w*|sozialversicherung\w*|personalausweis|fiscal|passeport|identité|sécurité sociale|nif|nie|dni|documento|pasaporte|seguridad social|cédula|\"id\"|tin|curp|rfc)\b|\"id\"")
PHONE_LABELS = re.compile(r"(?i)\b(?:tel|tél|telefon|phone|call|text|mobile|mobil|cell|fax|forwards|ring|dial|ask|appeler|llamar|teléfono|téléphone|erreichen|rufen|unter|reach|pager|whatsapp|sms|contact)\b")
OTHER_NUMBERS = re.compile(r"(?i)(?:\b(?:ticket|issue|bug|case|build|commit|revision|version|release|page|pages|line|lines|row|rows|port|host|ip|order|invoice|sku|isbn|doi|checksum|hash|size|offset|bytes|count|total|range|from|between|run|job|trace|span|id|v)\b|#)")
TOP_DOMAINS = {"com", "org", "net", "edu", "gov", "mil", "int", "info", "biz", "io", "dev", "app", "ai", "co", "me", "eu", "uk", "us", "ca", "au", "de", "at", "ch", "fr", "be", "es", "it", "nl", "pt", "mx", "ar", "br", "jp", "cn", "in", "example", "test", "invalid", "local", "localhost"}
# ---- end of fixed values ----

_MARKS = dict.fromkeys(i for i in range(0x300, 0x370))
_AT = r"(?:\s?@\s?|\s?\(at\)\s?|\s?\[at\]\s?|\s?\{at\}\s?|\s(?:at|arroba)\s)"
_DOT = r"(?:\.|\s?\[dot\]\s?|\s?\(dot\)\s?|\s?\{dot\}\s?|\s(?:dot|punto|punkt|point)\s)"
_AT_SIGN = re.compile(rf"(?i){_AT}")
_HOST = re.compile(rf"(?i)[a-z0-9][a-z0-9\-]*(?:{_DOT}[a-z0-9][a-z0-9\-]*)+(?![\w@])")
_DOT_BEFORE = re.compile(rf"(?i){_DOT}$")
_MAY_MAIL = re.compile(r"(?i)[\(\[\{]at[\)\]\}]|\s(?:at|arroba)\s[^\n]{1,80}?(?:\s(?:dot|punto|punkt|point)\s|[\(\[\{]dot)")
_DIGITS = re.compile(r"(?<![\w.\-/+])(?:\+|\(\+?)?\d[\d ().\-/ ‑]{5,22}\d(?!\w)")
_PHONES = re.compile(r"(?<![\w.\-/+])(?:(?:\+|00)?1[ .\-]?)?(?:\(\d{3}\) ?|\d{3}[ .\-]?)\d{3}[ .\-]?\d{4}(?![\w\-])|(?<![\w.\-/])(?:\+|00)\d{1,3}(?:[ .\-/]?\(?\d{1,5}\)?){2,6}(?![\w\-])|(?<![\w.\-/+])\(?0\d{1,4}\)?[ /\-]?\d{2,5}(?:[ \-]\d{2,5}){0,4}(?![\w\-])")
_IDS = re.compile(r"(?<![\w.\-/+])(?:\d{3}([\-. ]?)\d{2}\1\d{4}|[A-Za-z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-Za-z]|[A-Za-z]{1,2} ?\d{3}-?\d{4}|[A-Za-z]\d{7,8}[A-Za-z]?|[XYZxyz]?\d{7,8}[\- ]?[A-Za-z]|[12] ?\d{2} ?\d{2} ?\d{2} ?\d{3} ?\d{3}(?: ?\d{2})?|\d{2} ?\d{3} ?\d{3} ?\d{3}|[A-Za-z]{2}\d{6,7}|[A-Z](?=[A-Z0-9]{7,8}(?!\w))(?=[A-Z]*\d[A-Z]*\d)[A-Z0-9]{7,8}|\d{2}[A-Z]{2}\d{5})(?![\w\-])")
_W = r"[^\W\d_]+(?:['’\-][^\W\d_]+)*"
_EN_STREET = r"(?:street|st|road|rd|avenue|ave|lane|ln|drive|close|court|ct|crescent|row|terrace|place|boulevard|blvd|way|square|hill|walk|grove|gardens|mews|alley|parade|quay|yard|rise|circle|parkway)"
_HOUSE = r"\d{1,5} ?[a-z]?(?:[\-/]\d{1,4}[a-z]?)?"
_ENGLISH = re.compile(rf"(?i)(?<![\w.,:/\-#])\d{{1,5}}[a-z]?(?:-\d{{1,4}})? (?:{_W} ){{1,3}}?{_EN_STREET}(?!\w)")
_DE_STREET = r"(?:straße|strasse|str\.|weg|platz|ring|gasse|allee|ufer|damm|steig|hof|graben|markt|chaussee)"
_GERMAN = re.compile(rf"(?i)(?<![\w\-])(?:(?:(?:am|an der|zum|zur|alte|neue) )?[^\W\d_][^\W\d_\-]+-?{_DE_STREET}|{_W}[ \-]{_DE_STREET}) ?\d{{1,4}} ?[a-z]?(?!\w)")
_FR_STREET = r"(?:rue|avenue|allée|boulevard|bd|impasse|chemin|quai|place|cours|passage|route|square|sentier|ruelle)"
_FRENCH = re.compile(rf"(?i)(?<![\w.\-])\d{{1,4}} ?[a-z]?(?: (?:bis|ter|quater))?,? {_FR_STREET} (?:(?:de la|du|des|de|d['’]|de l['’]) ?)?{_W}(?: {_W}){{0,2}}")
_ES_STREET = r"(?:calle|avenida|avda\.?|plaza|paseo|camino|ronda|carrera|travesía|callejón|c/)"
_SPANISH = re.compile(rf"(?i)(?<!\w){_ES_STREET} (?:(?:de las|de los|de la|del|de) )?{_W}(?: {_W}){{0,3}}?,? (?:(?:n\.?\s?º|nº|núm\.?|no\.) ?)?\d{{1,4}} ?[a-z]?(?!\w)")
_TOKEN = re.compile(_W)
_PARTICLES = ("von der", "van der", "van den", "von", "van", "de la", "del", "de", "di", "da", "dos")
_PARTICLE_WORDS = {w for p in _PARTICLES for w in (p.split()[0], p.split()[0].title(), p.split()[0].upper())}
_GERMAN_WORDS = tuple(re.sub(r"\\", "", _DE_STREET)[3:-1].split("|"))
_GAP = re.compile(r"^[ \t ]+$")
_DIGIT = re.compile(r"\d")
_BLANK_ZERO = re.compile(" 0")


def fold(word: str) -> str:
    """Lower case without accents."""
    low = word.lower()
    return low if low.isascii() else unicodedata.normalize("NFKD", low).translate(_MARKS)


@dataclass
class NameStats:
    """What a list of known names says about a word: whether it is in the list, and how its beginning and end look."""

    given: set[str]
    family: set[str]
    _cache: dict[str, tuple] = field(default_factory=dict)

    def __post_init__(self):
        self.parts = []
        for names in (self.given, self.family):
            pieces = {p for n in names for p in re.split(r"[ \-'’]", n) if len(p) > 2}
            start = Counter(p[:k] for p in pieces for k in range(3, 6))
            end = Counter(p[-k:] for p in pieces for k in range(2, 8))
            self.parts.append((pieces, start, end))

    def _affix(self, piece: str, which: int) -> float:
        pieces, start, end = self.parts[which]
        if piece in pieces:
            return 1.0
        a = max((k for k in range(3, 6) if start[piece[:k]] >= 3 and k < len(piece)), default=0)
        b = max((k for k in range(2, 8) if end[piece[-k:]] >= 3 and k < len(piece)), default=0)
        return min(1.0, (a + b) / len(piece)) if a and b else 0.0

    def of(self, word: str) -> tuple[float, float, float, float, bool, bool, bool, bool, bool]:
        """(in given, in family, like given, like family, capitalised, all capitals, common word, may be part of a name, may begin one)."""
        known = self._cache.get(word)
        if known is None:
            f = fold(word)
            pieces = [p for p in re.split(r"[\-'’]", f) if p] or [f]
            like = [min(self._affix(p, k) for p in pieces) for k in (0, 1)]
            in_given = float(f in self.given or all(p in self.parts[0][0] for p in pieces))
            in_family = float(f in self.family or all(p in self.parts[1][0] for p in pieces))
            known = (in_given, in_family, like[0], like[1], word[0].isupper(), word.isupper() and len(word) > 1, f in NO_NAMES)
            may = not known[6] and (known[4] or in_given + in_family > 0 or max(like) >= 0.99)
            known = (*known, may, may or (len(word) == 1 and word.isupper()) or word in _PARTICLE_WORDS)
            if len(self._cache) < 500_000:
                self._cache[word] = known
        return known


def _around(text: str, a: int, b: int) -> tuple[str, str]:
    return text[max(0, a - 40) : a], text[b : b + 40]


def _last_words(before: str) -> tuple[str, str]:
    found = re.findall(r"[^\W\d_]+", before)
    return (found[-1].lower() if found else "", found[-2].lower() if len(found) > 1 else "")


def _edge(c: str) -> float:
    """A class of the character beside a span."""
    if not c:
        return 0.0
    if c in "\r\n":
        return 1.0
    if c.isspace():
        return 2.0
    if c in "([<{":
        return 3.0
    if c in ")]>}":
        return 4.0
    if c in "\"'`":
        return 5.0
    if c in ",;":
        return 6.0
    if c in ".!?":
        return 7.0
    if c == ":":
        return 8.0
    if c.isdigit():
        return 9.0
    if c.isalpha():
        return 10.0
    return 11.0


def _number_features(text: str, a: int, b: int) -> list[float]:
    s = text[a:b]
    before, after = _around(text, a, b)
    groups = re.findall(r"\d+", s)
    digits = "".join(groups)
    seps = {c for c in s if not c.isalnum()}
    label, phone = ID_LABELS.search(before), PHONE_LABELS.search(before[-18:])
    other = list(OTHER_NUMBERS.finditer(before[-24:]))
    label_at = max((len(before) - m.end() for m in ID_LABELS.finditer(before)), default=99) if label else 99
    other_at = min((24 - m.end() for m in other), default=99) if other else 99
    letters = "".join(c for c in s if c.isalpha())
    number_beside = bool(re.search(r"\d[ ,;\-/.]{1,2}$", before)) or bool(re.match(r"[ \-/.]{1,2}\d", after))
    return [
        len(digits), len(groups), len(groups[0]) if groups else 0, len(groups[-1]) if groups else 0, max(map(len, groups), default=0), min(map(len, groups), default=0),
        float(s[0] == "+"), float(s.startswith("00")), float(s[0] == "("), float(digits[:1] == "0"), float(digits[:1] == "1"), float(digits[:3] in ("000", "666") or digits[:1] == "9"), float(" " in seps), float("-" in seps), float("." in seps), float("/" in seps), float("(" in seps),
        len(letters), float(s[0].isalpha()), float(s[-1].isalpha()), float(letters.isupper()), float(letters.islower() and bool(letters)),
        min(label_at, 40), float(bool(ID_LABELS.search(after[:36]))), float(bool(phone)), float(bool(other)), min(other_at, 40), _edge(before[-1:]), _edge(after[:1]), float(number_beside), float(bool(re.match(r"[.,]?\d|[\-_]?\w|-", after))), float(len({len(g) for g in groups}) == 1 and len(groups) > 2),
        float(bool(groups) and len(groups) == 4 and "." in seps and all(int(g) < 256 for g in groups)),
        float(bool(re.match(r"\d{4}-\d{2}-\d{2}$", s))), float(len(groups) == 3 and list(map(len, groups)) == [3, 2, 4]), float(len(groups) == 3 and list(map(len, groups)) == [3, 3, 4]), float(before.count("\n") and not before.rsplit("\n", 1)[-1].strip(" +(")),
    ]


def _email_features(text: str, a: int, b: int) -> list[float]:
    s = text[a:b]
    before, after = _around(text, a, b)
    low = s.lower()
    spelled_at, spaced, bracket = bool(re.search(r"\s(?:at|arroba)\s", low)), " @" in s or "@ " in s, bool(re.search(r"[\(\[\{]at", low))
    dots = len(re.findall(r"\s(?:dot|punto|punkt|point)\s|[\(\[\{]dot", low))
    ats = len(re.findall(r"\s(?:at|arroba)\s|@|[\(\[\{]at", low))
    bare = re.sub(r"\s?[\(\[\{]dot[\)\]\}]\s?|\s(?:dot|punto|punkt|point)\s", ".", low)
    bare = re.sub(r"\s?[\(\[\{]at[\)\]\}]\s?|\s(?:at|arroba)\s|\s?@\s?", "@", bare)
    local, _, host = bare.rpartition("@")
    tail = host.rsplit(".", 1)[-1]
    return [
        float(spelled_at), float(spaced), float(bracket), dots, float("@" in s), len(local), len(host), host.count("."), float(host[:1].isdigit()), float(tail in TOP_DOMAINS), float(tail.isalpha()),
        float(bool(re.match(r":[^\s]", after))), float(bool(re.search(r"(?i)(?:clone|remote|ssh|scp|fetch|push|origin)\b[^\n]*$", before))), float(local == "git"), float(bool(re.search(r"(?i)\b(?:install|pkg|add|npm|package|icon|image|decorated)\b[^\n]*$", before))),
        float(tail in ("png", "jpg", "svg", "gif", "py", "rs", "ts", "tsx", "js", "css", "json", "toml")), float(bool(re.search(r"@\d", low))), float(bool(re.search(r"[._+\-]", local))), _edge(before[-1:]), _edge(after[:1]), float(before.endswith(("mailto:", "<", '"', "= "))), float(before.rstrip()[-1:] == "/" or "://" in before[-12:]),
        float(bool(re.search(r"(?i)(?:\sdot\s|[\(\[\{]dot[\)\]\}]\s?|[.@]\s?)$", before))), float(bool(re.match(r"(?i)\s?(?:\s(?:dot|at)\s|[\(\[\{](?:dot|at)|\.\w|@)", after))), ats,
    ]


_LOOSE = re.compile(r"(?i)\b(?:row|close|way|court|place|drive|hill|walk|ring|rise|place|cours|passage|hof|platz|square|circle|yard)\b")
_ADDRESS_LEADS = re.compile(r"(?i)(?:\baddress is|\baddress:?|\bat|\bto|\blives? (?:at|in)|\ban|\bau|\bà|\ba|\bin|adresse|anschrift|dirección|,)\s*$")


def _address_features(text: str, a: int, b: int, form: int) -> list[float]:
    s = text[a:b]
    before, after = _around(text, a, b)
    words = re.findall(r"[^\W\d_]+", s)
    caps = [w for w in words if w[0].isupper()]
    number = re.search(r"\d+", s)
    stop = sum(w.lower() in NO_NAMES and w.lower() not in ("de", "la", "du", "des", "del", "los", "las", "am", "an", "der", "zum", "zur", "le", "les") for w in words)
    return [
        float(form), len(words), len(caps) / max(1, len(words)), float(s.isupper()), float(s.lower() == s), len(number.group(0)) if number else 0, float(bool(_LOOSE.search(s))), stop, float(bool(_ADDRESS_LEADS.search(before))),
        float(bool(re.search(r"(?i)address|adresse|dirección|anschrift", before))), _edge(before[-1:]), _edge(after[:1]), float(bool(re.match(r",\s+[A-ZÀ-Þ]", after))), float("\n" == before[-1:] and after[:1] in ("\n", "\r")), float(bool(re.search(r"\d\s*$", before))), sum(len(w) for w in words) / max(1, len(words)),
        float(any(w.lower().endswith("s") and w.islower() for w in words[:-1])), float(bool(OTHER_NUMBERS.search(before[-14:]))), float(bool(re.match(r"(?i) (?:de|des|du|del|d['’])\b", after))), float(bool(re.search(r"(?i)\b(?:bis|ter)\b", s))),
    ]


def _name_features(text: str, a: int, b: int, form: int, given: tuple, family: tuple, middle: bool, particle: bool, beside: tuple[float, float]) -> list[float]:
    s = text[a:b]
    before, after = _around(text, a, b)
    one, two = _last_words(before[-30:])
    near = not re.search(r"[^\W\d_][^\n]*[.!?]\s+$", before[-30:]) if one else False
    after_word = re.match(r"[ \t]([^\W\d_]+)", after)
    nxt = after_word.group(1) if after_word else ""
    return [
        float(form), *given[:4], *family[:4], float(given[4]), float(given[5]), float(family[4]), float(family[5]), float(given[6]), float(family[6]), float(middle), float(particle), *beside,
        float(one in TITLES), float(one in LEADS and near), float(two in LEADS and near), float(one in ARTICLES and before.endswith(" ")), _edge(before[-1:]), _edge(after[:1]), float(bool(nxt) and nxt[0].isupper()), float(bool(re.match(r"\s*[<(]", after))), float(bool(re.match(r"[.\-_]?\w|@", after))), float(bool(re.search(r"[@.\-_/]$", before))),
        float(before.endswith((": ", '"', "\n", ","))), float(s == s.lower()), float(s == s.upper()), len(s), float(bool(nxt) and nxt.lower() in NO_NAMES), float(bool(re.match(r"(?i) (?:index|method|rule|law|metric|score|number|test|service|server|team|project|cluster|bridge|street|road|lane|avenue|filter|curve|principle|award)\b", after))),
    ]


_NO_WORD = (0.0, 0.0, 0.0, 0.0, False, False, False)
_LINE = re.compile(r"[^\r\n]+")


def _names(text: str, stats: NameStats) -> list[tuple[int, int, list[float]]]:
    tokens = [(*m.span(), m.group()) for m in _TOKEN.finditer(text)]
    known = stats._cache
    info = [known.get(t[2]) or stats.of(t[2]) for t in tokens]
    n, out = len(tokens), []
    may = [i[7] for i in info]

    def evidence(k: int) -> float:
        return max(info[k][:4]) if 0 <= k < n else 0.0

    def gap(k: int) -> str:
        """Between token k and the next."""
        return text[tokens[k][1] : tokens[k + 1][0]] if k + 1 < n else "\n"

    def plain(g: str) -> bool:
        return g == " " or bool(_GAP.match(g))

    def particle(k: int) -> int:
        """How many tokens from k are a particle before a family name."""
        if tokens[k][2] not in _PARTICLE_WORDS:
            return 0
        if k + 2 < n and plain(gap(k)) and tokens[k][2].lower() + " " + tokens[k + 1][2].lower() in _PARTICLES:
            return 2
        return int(tokens[k][2].lower() in _PARTICLES) if k + 1 < n else 0

    def family_at(k: int) -> tuple[int, bool] | None:
        """The last token of a family name that begins at k, and whether it has a particle."""
        if k >= n:
            return None
        p = particle(k)
        if p and all(plain(gap(j)) for j in range(k, k + p)) and k + p < n and may[k + p]:
            return k + p, True
        return (k, False) if may[k] else None

    for i in [k for k in range(n) if info[k][8]]:
        a, b, word = tokens[i]
        single = len(word) == 1 and word.isupper()
        starts = may[i] or single or (particle(i) > 0)
        if not starts:
            continue
        before = (evidence(i - 1) if i and plain(gap(i - 1)) else 0.0,)
        if single:
            if text[b : b + 1] == "." and i + 1 < n and plain(text[b + 1 : tokens[i + 1][0]]):
                end = family_at(i + 1)
                if end:
                    e = end[0]
                    out.append((a, tokens[e][1], _name_features(text, a, tokens[e][1], 2, _NO_WORD, info[e], False, end[1], (*before, evidence(e + 1) if plain(gap(e)) else 0.0))))
            continue
        if may[i] and i + 1 < n:
            g = gap(i)
            k, middle = i + 1, False
            if plain(g) and len(tokens[k][2]) == 1 and tokens[k][2].isupper() and k + 1 < n and gap(k)[:1] == "." and plain(gap(k)[1:]):
                k, middle = k + 1, True
            if plain(g):
                end = family_at(k)
                if end:
                    e = end[0]
                    out.append((a, tokens[e][1], _name_features(text, a, tokens[e][1], 0, info[i], info[e], middle, end[1], (*before, evidence(e + 1) if plain(gap(e)) else 0.0))))
        end = family_at(i)
        if end and end[0] + 1 < n and re.fullmatch(r",[ \t ]+", gap(end[0])) and (may[end[0] + 1] or len(tokens[end[0] + 1][2]) == 1):
            e = end[0] + 1
            stop = tokens[e][1]
            middle = False
            if e + 1 < n and plain(gap(e)) and len(tokens[e + 1][2]) == 1 and tokens[e + 1][2].isupper() and text[tokens[e + 1][1] : tokens[e + 1][1] + 1] == "." and len(tokens[e][2]) > 1:
                middle = True
            follows = evidence(e + 1) if plain(gap(e)) else 0.0
            features = _name_features(text, a, stop, 1, info[e], info[end[0]], middle, end[1], (*before, follows))
            out.append((a, stop, features))
    return out


def _balanced(text: str, a: int, b: int) -> tuple[int, int]:
    """The span without an opening bracket at its front or a closing one at its end that has no partner in it."""
    s = text[a:b]
    if s.startswith("(") and ")" not in s:
        a += 1
    elif s.endswith(")") or s.count("(") > s.count(")"):
        inner = s.rfind("(") if s.count("(") > s.count(")") else len(s)
        b = a + len(s[:inner].rstrip(" (-/.)")) if inner > 0 else b
    return a, b


def _emails(text: str) -> dict[tuple[int, int], None]:
    """Spans around every sign or word for @, grown outwards; a spelled-out local part is also tried without its first words."""
    spans: dict[tuple[int, int], None] = {}
    for m in _AT_SIGN.finditer(text):
        host = _HOST.match(text, m.end())
        if not host:
            continue
        starts, at = [], m.start()
        while True:
            run = at
            while run and (text[run - 1].isalnum() or text[run - 1] in "_.+-"):
                run -= 1
            while run < at and not (text[run].isalnum() or text[run] == "_"):
                run += 1
            if run == at or (run and text[run - 1] == "@"):
                break
            starts.append(run)
            dot = _DOT_BEFORE.search(text, max(0, run - 12), run)
            if not dot or dot.group() == ".":
                break
            at = dot.start()
        for a in dict.fromkeys([*starts[-2:], *starts[:1]]):
            spans[(a, host.end())] = None
    return spans


def candidates(text: str, stats: NameStats) -> dict[str, list[tuple[int, int, list[float]]]]:
    """kind -> (start, end, features) of every candidate span. Numbers and addresses are looked for in lines that hold a digit."""
    found: dict[str, list[tuple[int, int, list[float]]]] = {k: [] for k in KINDS}
    if "@" in text or _MAY_MAIL.search(text):
        found["email"] = [(a, b, _email_features(text, a, b)) for a, b in _emails(text) if "@" in text[a:b] or _MAY_MAIL.search(text, a, b)]
    for line in _LINE.finditer(text):
        start, stop = line.span()
        if not _DIGIT.search(text, start, stop):
            continue
        # every digit as 0, and no blank before it: a street word before a number is then one substring
        tight = _BLANK_ZERO.sub("0", _DIGIT.sub("0", line.group().lower()))
        spans = {}
        many = tight.count("0") > 5
        for pattern in (_DIGITS, _PHONES) if many else ():
            for m in pattern.finditer(text, start, stop):
                a, b = _balanced(text, m.start(), m.end())
                if 7 <= sum(c.isdigit() for c in text[a:b]) <= 15:
                    spans[(a, b)] = None
        found["phone"] += [(a, b, _number_features(text, a, b)) for a, b in spans]
        found["id_number"] += [(m.start(), m.end(), _number_features(text, m.start(), m.end())) for m in _IDS.finditer(text, start, stop)] if tight.count("0") > 3 else []
        for form, pattern in enumerate((_ENGLISH, _GERMAN, _FRENCH, _SPANISH)):
            if form == 1 and not any(w + "0" in tight for w in _GERMAN_WORDS):
                continue
            for m in pattern.finditer(text, start, stop):
                a, b = m.start(), m.end()
                if form == 2:  # words after the street name may belong to the sentence
                    words = list(_TOKEN.finditer(text, a, b))
                    while len(words) > 2 and (words[-1].group(0).lower() in NO_NAMES | {"about"} or (words[-1].group(0).islower() and not text[a:b].islower())):
                        words.pop()
                    b = words[-1].end()
                found["address"].append((a, b, _address_features(text, a, b, form)))
    found["name"] = _names(text, stats)
    return found
