"""A labelled sample to fit the span classifiers on: invented sentences with known spans.

The sentences are drawn from frames of mail, forms, logs, notes and prose that do and do not hold
personal information, in English, German, French and Spanish; none is taken from a corpus. Names come
from the list of known names, from names of several traditions, and from invented ones, so that the
classifiers also see names that no list holds. The size of the sample is a parameter and bounded.
"""

from __future__ import annotations

import random

# ---- fixed values: frames; {N} name {E} email {P} phone {I} identity number {A} address, {w} filler ----
FRAMES = [
    "From: {N} <{E}>\nTo: {N} <{E}>\n", "Sent by {N} to {E}", "To: {E}; Cc: {E}", "Attn: {N}, {A}", "Dear {N},", "Hello {N}, here is the {w}.", "Kind wishes,\n{N}\nTel: {P}\nMail: {E}", "Sincerely,\n{N}\n{A}", "Yours,\n{N}\n{P}\n", "Love,\n{N}\n{A}\n{P}", "Yours truly,\n{N}\n", "{T} {N}\n{A}\n{P}\n", "{N} is here.", "{N} arrives in {C} soon.", "{N} takes the {w} home.", "then {N} came", "{N} joins us in May.", "bring it to {N}", "minutes by {N}", "an {N} ({P})", "{N} ({P})", "pregunte por {N}", "frag {N}", "chez {N}", "{N} has left the {w}.", "{N} will bring it.", "the {w} by {N}", "You may speak to {N}.", "unter {P} erreichbar", "-- \n{N} | {P} | {E}", "{N}\n{A}\n{C}\n", "{N} <{E}>", "{N} ({E})", "{N}, {P}", "{N}: {P}",
    "Name: {N}\nAddress: {A}\nPhone: {P}\n{L}: {I}\n", "applicant={N}; {L}={I}", "Full name {N}, {L} {I}.", "Customer {N} moved to {A} in {C}.", "The parcel for {N} went to {A}, {C} {z}.", "We met {N} at {A}.", "{T} {N} called from {P}.", "{T} {N} and {T} {N} signed the {w}.", "Written by {N} and {N}.", "The {w} was approved by {N}.", "Credit for the {w} belongs to {N}, {N} and {N}.",
    "According to {N}, the {w} is fine.", "I spoke with {N} about the {w}, who uses {E}.", "{N} said that the {w} works.", "{N} lives in {A}, {C}.", "Yesterday {N} changed the {w}.", "Talk to {N} first.", "Assigned to {N} since May.", "Author: {N}", "authors = [\"{N} <{E}>\"]", "maintainer: {N} <{E}>", "Copyright 2019 {N}", "Contact: {E}", "Questions? Write to {E} or ring {P}.", "Ring {P} between nine and five.", "Support line {P}, fax {P}.", "Mobile {P}", "WhatsApp: {P}",
    "My number is {P}.", "Her new number, {P}, is private.", "Reach the clinic at {P}.", "sms to {P} failed", "dialled {P} twice", "phone: \"{P}\"", "{\"tel\": \"{P}\", \"mail\": \"{E}\"}", "{\"first_last\": \"{N}\", \"{L}\": \"{I}\"}", "mail={E} result=sent", "user {E} logged in", "password reset for {E}", "<a href=\"mailto:{E}\">", "{E}, {E}", "{N};{A};{P};{E};{I}", "{N},{E},{I}", "{N}\t{P}\t{I}", "{P}", "{N}", "{E}", "{A}", "{I}",
    "Our office is at {A}.", "Deliver it to {A}, {C}.", "He gave {A} as his home.", "Invoice address: {A}, {z} {C}", "{L}: {I}", "{L} {I}", "with {L} {I} on the form", "the {w} shows the {L} {I}", "Copy of {L} no. {I} attached", "{I} is the {L} of {N}.", "masked {L} ({I})",
    "Von: {N} <{E}>", "Lieber {N}, anbei der {w}.", "{D} {N} hat den {w} gesehen.", "Viele Grüße\n{N}\nTelefon {P}", "Gesprochen mit {N}, Nummer {P}.", "Erstellt von {N} und {D} {N}", "Wohnhaft in {A}, {z} {C}.", "Bitte schicken an {A}.", "{L} lautet {I}", "Unter {P} oder per Mail an {E}.", "Laut {N} geht es.",
    "De : {N} <{E}>", "Cher {N}, voici le {w}.", "{F} {N} a vu le {w}.", "Bien à vous,\n{N}\nTél. {P}", "Rédigé par {N} et {F} {N}", "Domicilié au {A}, {z} {C}.", "Livraison au {A}.", "{L} : {I}", "Joindre le {P} ou {E}.", "Selon {N}, tout va bien.",
    "De: {N} <{E}>", "Hola {N}, aquí está el {w}.", "{S} {N} vio el {w}.", "Un saludo,\n{N}\nTel. {P}", "Redactado por {N} y {N}", "Vive en {A}, {C}.", "Entregar en {A}.", "con {L} {I}", "Teléfono {P}, correo {E}.", "Según {N}, funciona.", "contactar con {N} ({P})",
]
BARE = [
    "The {g} server needs {d} ms.", "The {f} {m} gives a {w}.", "A {f} {m} is one kind of {w}.", "{f} {m}", "{f}'s {m} holds for a {w}.", "{f} wrote about the {w}.", "{g} is late today.", "We use the {f} {m} and the {g} {m} in every {w}.", "According to {f} this works.", "named after {f}", "the {g} project", "{g} and {f} are names of machines.", "class {W}{W}", "The {W} {W} is new.", "{W} {W} and {W} {W} differ.", "{W} {w} {W}", "Chapter {d2}: {W} and {W}", "# {W} {W}", "## {W} {w}", "* {W}: {w} {w}", "{W}, {W} and {W} are done.",
    "{C} is far away.", "from {C} to {C}", "In {C}, {W} is closed.", "{C} and {C} voted.", "near {C}, {d2} km", "When {w}, {W} {w} wins.", "On {D2}, {W} {w} began.", "By {W} {w}.", "For {W} {W} see below.", "With {W} and {w}", "To {W} or not", "At {W} level", "the {W} of {W}", "If {W} {w}, then {W}.", "Under {W} {w} it rose.", "{W} {W} {W}",
    "pip add {w}=={v}", "npm add @{w}/{w}@{v}", "uses {w}@{v}", "add @{w}/{w}@{v}", "{w}@{v}", "with @{w}/{w}@{v} first", "yarn up @{w}/{w}", "git remote add up git@{w}.{w}.org:{w}/{w}.git", "scp file root@{w}:/srv/{w}", "git@{w}.test:{w}.git", "picture {w}@2x.jpg", "@{w}.{w}\ndef {w}(): pass", "@{W}({w})", "look at {w} dot {w}", "meet at {w}", "at {w}.{w} we stop", "read https://{w}.example/{w}@{v}",
    "{w}-{d4}", "{W}-{d3}", "case {d3}-{d4}", "bug #{d4}, line {d3}", "lines {d3}-{d4}", "pages {d2}-{d3}", "IP 192.168.{d2}.{d2} port {d4}", "10.{d2}.{d2}.{d}:{d4}", "{d3} {d3} {d4} {d4}", "{d2} {d2} {d2} {d2}", "{d8}", "total {d9} bytes", "{d10} ms since start", "sha {h}", "commit {h} of {d2}", "id {d9}", "order {d10}", "invoice {d3}-{d2}-{d4}", "v{v}", "release {d3}.{d2}.{d4}", "on {Y}-{d2}-{d2} at {d2}:{d2}", "{Y}-{d2}-{d2}T{d2}:{d2}:{d2}", "{d17}", "{h}-{d4}", "uuid {h}-{d4}-{d4}", "isbn {d3}-{d}-{d3}-{d5}", "between {d3} and {d4}", "range {d3}-{d3}", "sizes: {d3}, {d4}, {d5}", "{d3}/{d4}", "rate {d}.{d3}", "build {d4}.{d3}", "{d3}-{d3}-{d4}x", "x{d3}-{d3}-{d4}", "seconds: {d2} {d3} {d4}", "{w}_{d8}",
    "{d} rows a {w} way", "{d} {w} {x}", "{d} {W} {w} {x}", "{d} {w} {w} {x}", "has {d} {w} {x}", "{d} {W} je {x}", "the {d} {x}", "{w} {d} {W} {w} {x}.", "about {d2} {w} court", "{d2} open {w} close", "drive {d2}", "week {d2} of the road", "{d} places to hill", "{d} {w} {w} square", "step {d2} on the way", "{d2} rue", "im Ring {d2} Meter", "{W} Weg", "Platz {d} von {d2}", "{d2} place de parking", "calle sin {w}", "row {d2} of {d3}", "plaza {d} de {d2}", "{d} boulevard plans",
    "Wenn {w}, dann {W} und {W}.", "Der {W} und die {W} fehlen.", "Das {W} {W} hat {d2} {W}.", "Im {W} steht {W}.", "Seit {W} ist {W} da.", "Nach {W} kommt {W}.", "{W} von {W}", "Le {W} et la {W} du {w}.", "La valeur {w} vaut {d2}.", "Dans {W}, {W} manque.", "El {W} de la {W} sube {d2}.", "Para {W} y {W}.", "Los {w} de {W}.", "{w} {w} {w} {w}.", "The {w} of {w} and {w}.", "by {w} with {w}", "from {W}", "to {w} and {w}", "ask {w}", "called {w} {W}",
]
WORDS = "house garden river bread stone paper light number winter music train window letter market silver forest engine signal buffer thread socket cursor kernel driver folder packet switch router server client report ticket button screen branch merge query table column index filter stream status result answer change update design review budget project meeting service account payment product network storage backup archive library module package version control process machine language pattern problem reason question example section chapter figure summary average maximum follow-up built-in thirty-one twenty-two log-in read-only".split()
THINGS = ["Index", "method", "rule", "law", "score", "Bridge", "test", "curve", "server", "Award", "principle", "theorem", "effect", "scale", "transform", "filter", "algorithm", "Institute", "Prize", "Foundation", "Street", "tree"]
LABELS = [
    "SSN", "social security number", "passport", "passport number", "passport no.", "tax id", "TIN", "NI number", "national insurance", "national id", "identity number", "identity card", "ID no.", "id number", "driver id", "Steuer-ID", "Steuernummer", "Reisepass", "Pass-Nr.", "Ausweisnummer", "Personalausweis", "Sozialversicherungsnummer",
    "n° fiscal", "numéro fiscal", "passeport", "numéro d'identité", "carte d'identité", "numéro de sécurité sociale", "NIF", "DNI", "NIE", "documento", "pasaporte", "número de identidad", "seguridad social", "cédula",
]
TOWNS = ["Springfield", "Riverton", "Ashford", "Milton", "Santa Rosa", "New Haven", "San Marino", "Port Louis", "Saint-Denis", "Neustadt", "Bad Homburg", "Frankfurt", "Villeneuve", "Montreuil", "Villa Nueva", "Los Alamos", "Lake City", "Fort Worth", "Grand Rapids", "Stratford"]
HOSTS = ["example.com", "mail.example.org", "example.net", "post.example.de", "correo.example.es", "courriel.example.fr", "university.example.edu", "shop.test", "my-company.test", "dept.office.invalid", "gmx.example", "ops.internal.example"]
#: names of several traditions, most of them on no list
GIVEN = [
    "Rosemary", "Takeshi", "Galina", "Priya", "Fatima", "Chen", "Ingrid", "Kwame", "Aoife", "Dmitri", "Yusuf", "Leila", "Bjørn", "Zofia", "Tomás", "María", "José", "Jürgen", "Günther", "Élodie", "François", "Chiara", "Giuseppe", "Hiroshi", "Sakura", "Nguyen", "Thandiwe", "Emeka", "Siobhán", "Rhys", "Anika", "Ravi", "Svetlana", "Mehmet", "Ayşe", "Katarzyna", "Petra", "Lars", "Astrid", "João",
    "Beatriz", "Walter", "Harold", "Edith", "Florence", "Winston", "Abigail", "Tyrone", "Latoya", "Hugo", "Amélie", "Jean", "Pilar", "Javier", "Ximena", "Heinz", "Ulrike", "Wolfgang", "Miriam", "Noah", "Eli", "Omar", "Amir", "Soo", "Minh", "Ivo", "Ana", "Ian", "Bo", "Li",
]
FAMILY = [
    "Okafor", "Yamamoto", "Sokolova", "Sharma", "Hassan", "Wei", "Lindqvist", "Mensah", "O'Brien", "Volkov", "Demir", "Haddad", "Nilsen", "Kowalski", "García", "Fernández", "Müller", "Schröder", "Lefèvre", "Dubois", "Rossi", "Esposito", "Tanaka", "Nakamura", "Tran", "Dlamini", "Eze", "MacDonald", "Llewellyn", "Patel", "Iyer", "Ivanova", "Yılmaz", "Nowak", "Novák", "Svensson", "Johansson",
    "Silva", "Pereira", "Whitfield", "Baker", "Carpenter", "Shepherd", "Underwood", "Blackwell", "Hawthorne", "Fitzgerald", "Beaumont", "Moreau", "Delgado", "Herrera", "Quintero", "Zimmermann", "Baumgartner", "Vogel", "Kaufmann", "Goldberg", "Cohen", "Al-Sayed", "Kim", "Park", "Le", "Ng", "Lee", "Ali", "Diaz", "Ruiz", "Ford", "Stone", "Hill", "Young",
]
EN = ["Street", "St", "Road", "Rd", "Avenue", "Ave", "Lane", "Drive", "Close", "Court", "Crescent", "Row", "Terrace", "Place", "Blvd", "Way", "Square", "Grove", "Walk", "Parade"]
EN_NAMES = ["Main", "High", "Church", "Park", "Station", "Victoria", "King's", "Queen", "Mill", "Oak", "Elm", "Maple Ridge", "Upper Green", "Old Post", "North Bridge", "Sunset", "Washington", "Abbey", "Castle", "East Harbor"]
DE = ["straße", "str.", "weg", "platz", "ring", "gasse", "allee", "damm", "ufer"]
DE_NAMES = ["Haupt", "Bahnhof", "Schul", "Garten", "Berg", "Goethe", "Schiller", "Kirch", "Wald", "Mozart", "Linden"]
FR = ["rue", "avenue", "allée", "boulevard", "impasse", "chemin", "quai", "place"]
FR_NAMES = ["de la République", "des Fleurs", "du Moulin", "Victor Hugo", "de l'Église", "du Marché Saint-Jean", "des Écoles", "de Paris", "Pasteur", "du Général Leclerc", "de la Gare"]
ES = ["Calle", "Avenida", "Plaza", "Paseo", "Camino"]
ES_NAMES = ["Mayor", "de la Constitución", "del Sol", "de las Flores", "de los Reyes", "San Juan", "de Alcalá", "del Mar", "Real"]
# ---- end of fixed values ----


class Sampler:
    def __init__(self, given: list[str], family: list[str], seed: int):
        self.r = random.Random(seed)
        self.given, self.family = given, family
        self.plain = [x for x in family if " " not in x]

    def word(self) -> str:
        return self.r.choice(WORDS)

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def invented(self) -> str:
        mid = self.r.choice(["a", "e", "i", "o", "u", "an", "or", "el", "is"])
        return (self.r.choice("BCDFGHJKLMNPRSTVWZ") + mid + self.r.choice("bdfglmnrstvk") + self.r.choice(["a", "o", "en", "ert", "ine", "ley", "ton", "er", "ski", "mann"])).capitalize()

    def one(self, names: list[str]) -> str:
        pick = self.r.random()
        if not names or pick < 0.06:
            return self.invented()
        if pick < 0.30:
            return self.r.choice(FAMILY if names is self.family else GIVEN)
        if self.r.random() < 0.35:  # a name the list does not hold, of the same make
            a, b = self.r.choice(names), self.r.choice(names)
            if " " not in a + b and "-" not in a + b and len(a) > 4 and len(b) > 4:
                return a[: self.r.randint(3, 4)] + b[-self.r.randint(3, max(3, len(b) - 3)) :]
        return self.r.choice(names)

    def name(self) -> tuple[str, str, str]:
        r = self.r
        g, f = self.one(self.given), self.one(self.family)
        if r.random() < 0.08:
            g += "-" + self.one(self.given)
        if r.random() < 0.06 and "-" not in f and " " not in f:
            f += "-" + self.one(self.plain)
        form = r.random()
        if form < 0.55:
            s = f"{g} {f}"
        elif form < 0.72:
            s = f"{f.upper() if r.random() < 0.3 else f}, {g}"
        elif form < 0.84:
            s = f"{g} {r.choice('ABCDEGHJKLMRST')}. {f}"
        else:
            s = f"{g[0]}. {f}"
        case = r.random()
        if case < 0.07:
            s = s.upper()
        elif case < 0.13 and ". " not in s:
            s = s.lower()
        return s, g, f

    def email(self) -> str:
        r = self.r
        _, g, f = self.name()
        g, f = ("".join(c for c in x.lower() if c.isascii() and c.isalpha()) or "x" for x in (g, f))
        local = r.choice([f"{g}.{f}", f"{g}_{f}", f"{f}-{g[0]}", f"{g}{r.randint(1, 99)}", f"{g[0]}{f}", g, f"{f}.{g}", f"{g}.{f}+{self.word()}"])
        host = r.choice(HOSTS)
        form = r.random()
        if form < 0.62:
            s = f"{local}@{host}"
            return s.upper() if r.random() < 0.1 else s.title() if r.random() < 0.08 else s
        at = r.choice([" @ ", "(at)", " at ", " [at] ", " (at) "])
        dot = r.choice([" dot ", " [dot] "]) if at in (" at ", " [at] ") else "."
        return (local.replace(".", dot) if dot != "." else local) + at + host.replace(".", dot)

    def phone(self) -> str:
        d, r = self.digits, self.r
        a, b, c = d(3), d(3), d(4)
        return r.choice([
            f"+1 {a} {b} {c}", f"+1-{a}-{b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"1{a}{b}{c}", f"+49 {d(2)} {d(5)} {d(3)}", f"0049 {d(3)} {d(7)}", f"0{d(2)}/{d(5)}-{d(3)}", f"+44 {d(4)} {d(6)}", f"0{d(4)} {d(6)}", f"+44{d(10)}",
            f"+33 {d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"(0{d(1)}) {d(4)} {d(4)}", f"+61 {d(3)} {d(3)} {d(3)}", f"+81 {d(1)}-{d(4)}-{d(4)}", f"+39 {d(2)} {d(4)} {d(4)}", f"+{r.choice('123456789')}{d(1)} {d(3)} {d(4)} {d(3)}", f"+34 {d(3)} {d(3)} {d(3)}", f"0{d(3)} {d(7)}",
        ])

    def identity(self) -> str:
        d, r = self.digits, self.r
        sep = r.choice(["-", " ", ".", ""])
        l2, l1 = r.choice("ABCEGHJKLNPRSTWXYZQ") + r.choice("ABCEGHJKLNPRSTWXYZQ"), r.choice("ABCD")
        s = r.choice([sep.join([d(3), d(2), d(4)]), sep.join([r.choice(["000", "666", "9" + d(2)]), d(2), d(4)]), f"{l2} {d(2)} {d(2)} {d(2)} {l1}", f"{l2}{d(6)}{l1}", f"{l2}{d(7)}", f"{l2} {d(7)}", f"{l2}{d(3)}-{d(4)}", f"{d(8)}{l1}", f"{d(8)}-{l1}", f"{r.choice('XYZ')}{d(7)}{l1}", f"{r.choice('CFGHJK')}{d(2)}{l1}{d(2)}{r.choice('LTX')}{d(2)}", f"{d(2)}{l2}{d(5)}", f"{r.choice('12')} {d(2)} {d(2)} {d(2)} {d(3)} {d(3)} {d(2)}", f"{d(2)} {d(3)} {d(3)} {d(3)}", f"{l2[0]}{d(8)}"])
        return s.lower() if r.random() < 0.12 else s

    def address(self) -> str:
        r = self.r
        n = str(r.randint(1, 240)) + (r.choice("abcd") if r.random() < 0.15 else "")
        form = r.random()
        if form < 0.5:
            s = f"{n} {r.choice(EN_NAMES)} {r.choice(EN)}"
        elif form < 0.68:
            stem, kind = r.choice(DE_NAMES), r.choice(DE)
            s = f"{stem}{kind} {n}" if r.random() < 0.75 else f"{stem}er {kind.title()} {n}"
        elif form < 0.85:
            s = f"{n}{r.choice(['', ' bis', ' ter', ','])} {r.choice(FR)} {r.choice(FR_NAMES)}"
        else:
            s = f"{r.choice(ES)} {r.choice(ES_NAMES)}{r.choice(['', ',', ', n.º'])} {n}"
        case = r.random()
        return s.upper() if case < 0.07 else s.lower() if case < 0.2 else s

    def sentence(self, frame: str) -> tuple[str, list[tuple[int, int, str]]]:
        r, text, spans, i = self.r, "", [], 0
        simple = {
            "w": self.word, "W": lambda: self.word().capitalize(), "g": lambda: self.one(self.given), "f": lambda: self.one(self.family), "m": lambda: r.choice(THINGS), "C": lambda: r.choice(TOWNS), "x": lambda: r.choice(EN).lower(), "L": lambda: r.choice(LABELS), "z": lambda: self.digits(5),
            "T": lambda: r.choice(["Mr", "Mrs", "Ms", "Dr."]), "D": lambda: r.choice(["Herr", "Frau"]), "F": lambda: r.choice(["M.", "Mme"]), "S": lambda: r.choice(["La señora", "El señor"]),
            "D2": lambda: f"{r.choice(['Monday', 'Tuesday', 'Friday'])}", "Y": lambda: str(r.randint(1990, 2039)),
            "v": lambda: f"{r.randint(0, 9)}.{r.randint(0, 99)}.{r.randint(0, 99)}", "h": lambda: "".join(r.choice("0123456789abcdef") for _ in range(10)) if r.random() < 0.6 else r.choice("abcdef") + self.digits(8) + r.choice("abcdef"), "d": lambda: str(r.randint(1, 4000)),
            **{f"d{k}": (lambda k=k: str(r.randint(1, 9)) + self.digits(k - 1)) for k in (2, 3, 4, 5, 8, 9, 10, 17)},
        }
        kinds = {"N": ("name", lambda: self.name()[0]), "E": ("email", self.email), "P": ("phone", self.phone), "I": ("id_number", self.identity), "A": ("address", self.address)}
        while i < len(frame):
            end = frame.find("}", i)
            key = frame[i + 1 : end] if frame[i] == "{" and end > 0 else ""
            if key in kinds:
                kind, make = kinds[key]
                s = make()
                spans.append((len(text), len(text) + len(s), kind))
                text, i = text + s, end + 1
            elif key in simple:
                text, i = text + simple[key](), end + 1
            else:
                text, i = text + frame[i], i + 1
        return text, spans

    def document(self) -> tuple[str, list[tuple[int, int, str]]]:
        text, spans = "", []
        for _ in range(self.r.randint(3, 7)):
            bare = self.r.random() < 0.5
            s, found = self.sentence(self.r.choice(BARE if bare else FRAMES))
            if bare:  # headings and shouting
                style = self.r.random()
                s = s.upper() if style < 0.06 else s.title() if style < 0.1 else s
            spans += [(a + len(text), b + len(text), k) for a, b, k in found]
            text += s + self.r.choice([" ", " ", "\n", "\n\n", "\r\n"])
        return text, spans
