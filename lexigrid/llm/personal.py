"""p8: personal information in free text.

Regular expressions propose spans; validators (check digits of CPF and DNI/NIE,
Luhn, mod 97) confirm them; words nearby raise or lower the score.  A number
whose form carries a check digit needs no label if the digit fits, and isn't
reported without a label if it doesn't; a label is enough for itself.
Spans that reach the threshold are reported exactly as they stand and replaced
by a typed placeholder.

Defined results: null and empty texts have no spans and are returned unchanged.
Overlapping spans: the higher score wins, then the longer, then the earlier.
Whole texts are scanned; a repeated text within a batch is scanned once.
"""

from __future__ import annotations

import re as plain_re

import regex as re

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..plans.spread import spread

THRESHOLD = 3.0
BEFORE, AFTER = 34, 28
KINDS = ("email", "phone", "id_number", "address", "name")

# Given names of several languages; a hint, never needed beside a cue.
GIVEN = set(
    "ada adam alan alba albert alberto alejandra alejandro alex alexander alice alicia alma ana anders andrea andreas andrés andrew angela anita "
    "anna anne anselm antonio antônio arthur artur barbara beatriz ben benjamin bernd bernardo birgit björn brian bruno caio camila carla carlos "
    "carmen carolina catarina cecília charles charlotte chris christine clara claudia cláudia daniel daniela david débora diana diego dieter edgar "
    "eduardo elena elisa elizabeth emily emma enrique erik ernst eva fabio felipe felix fernanda fernando francisco frank gabriel george gerd "
    "gonzalo grace greta guilherme gustavo hanna hannah hans heike helen helena henry hugo ines inés inês ingrid irene isabel ivan jack jakob james "
    "jana javier joana joão jochen john jonas jorge josé joseph juan julia juliana jürgen karin karl katrin klaus lars laura lena leon leonor "
    "lourdes lucas lucía lúcia luis luisa luiz manuel marcelo márcia marco margaret maria maría mariana marta martin mary mateus matthias michael "
    "miguel monika natalia nicolás nina nora oliver olga oscar otto owen pablo patricia paul paula paulo pedro peter petra rafael raquel raúl renata "
    "ricardo robert roberto rosa rui ruth sabine samuel sandra sara sarah sebastian sérgio silvia simon sofia sonia stefan susana susanne teresa "
    "theo thiago thomas tiago tobias ulrike ursula uwe vera verena victor víctor walter wolfgang yolanda".split()
)
# Words that name a kind of street.
EN_WAYS = "Street|St|Road|Rd|Lane|Ln|Avenue|Ave|Close|Drive|Dr|Way|Court|Ct|Place|Pl|Square|Sq|Terrace|Crescent|Boulevard|Blvd|Row|Walk|Hill|Gardens|Mews|Parkway"
IBERIAN_WAYS = "Rua|R\\.|Avenida|Av\\.|Avda\\.|Travessa|Tv\\.|Praça|Pça\\.|Alameda|Al\\.|Estrada|Rodovia|Largo|Calle|C/|C\\.|Paseo|Pº|Plaza|Pza\\.|Camino|Carretera|Ctra\\.|Ronda|Rambla|Travesía|Calçada|Beco|Ladeira"
DE_WAYS = "straße|strasse|str\\.|weg|gasse|platz|allee|ring|damm|ufer|steig|pfad|markt|chaussee|hof|graben|wall|stieg|berg"

AT = r"(?:\s?@\s?|\s?[\[({]\s?(?:at|arroba)\s?[\])}]\s?|%40)"
AT_SIGN = re.compile(r"@|%40|[\[({]\s?(?:at|arroba)\b", re.I)
DOT = r"(?:\.|\s?[\[({]\s?(?:dot|ponto|punto|punkt)\s?[\])}]\s?)"
EMAIL = re.compile(rf"(?<![\w.%+\-@/])[\p{{L}}\p{{N}}](?:[\p{{L}}\p{{N}}_.%+\-]*[\p{{L}}\p{{N}}_+\-])?{AT}[\p{{L}}\p{{N}}](?:[\p{{L}}\p{{N}}\-]*[\p{{L}}\p{{N}}])?(?:{DOT}[\p{{L}}\p{{N}}](?:[\p{{L}}\p{{N}}\-]*[\p{{L}}\p{{N}}])?)*{DOT}\p{{L}}{{2,24}}(?![\w@])", re.I)

PHONE = plain_re.compile(r"(?<![\w.,/+\-(#])(?=[+(\d][\d ().\-/ ]{6})(?:\+|00)?(?:\(\d{1,5}\)|\d{1,14})(?:(?:[ .\-/]| | - ){1,2}(?:\(\d{1,5}\)|\d{2,8})){0,6}(?![\w]|[.,\-/]\d)")
PHONE_BEFORE = re.compile(r"(?:\b(?:tel|telephone|phone|fone|telefone|teléfono|telefono|telefon|fon|mobile|mobil|mob|cell|cel|celular|móvil|movil|whatsapp|handy|call|ring|me on|dial|rückruf|rückruf unter|ruf|anruf|ligue|ligar|llamar|llame|contato|contact|fax|sms|hotline|tfno)\b[^\n\w]{0,4}(?:\w{1,6}[^\n\w]{1,2})?|phone\W{0,4}(?:=|:)\W{0,3})$", re.I)
PHONE_AFTER = re.compile(r"^(?:[,;]? ?(?:ramal|ext\b|extension|x\d|anexo|durchwahl|int\b)| ?/ ?desk line|['\"]? AS \w*(?:phone|tel|fone|mobile)|,? I'm in)", re.I)

ID_BEFORE = re.compile(r"\b(?:ssn|social security(?: number| no\.?)?|(?:ni|nino|national insurance)(?: number| no\.?)?|cpf\w*|cnpf|rg|nif|nie|dni|nuss|cuil|cuit|curp|rfc|pis|cnh|nin|tin|itin|passport|pasaporte|passaporte|reisepass|personalausweis|ausweis\w*|steuer-?id\w*|steuer(?:nummer|identifikationsnummer)|idnr|id card|identity (?:card|number|document)|documento(?: de identidad| de identidade)?|identidad|identidade|contribuinte|tax (?:id|number)|taxpayer)\b[^\n\w]{0,4}(?:(?:number|no|nº|n\.º|nr|num|núm|número|is|é|es|lautet)\b[^\n\w]{0,4})?$", re.I)
SSN = plain_re.compile(r"(?<![\w.\-/+])\d{3}([ \-.])\d{2}\1\d{4}(?![\w]|[\-/]\d)")
NINO = plain_re.compile(r"(?<![\w\-])[A-Za-z]{2}[ \-]?\d{2}[ \-]?\d{2}[ \-]?\d{2}[ \-]?[A-Da-d](?![\w])")
CPF = plain_re.compile(r"(?<![\w.\-/+])(?:\d{3}[. ]\d{3}[. ]\d{3}[\- ./]\d{2}|\d{9}-\d{2}|\d{11})(?![\w]|[.\-/]\d)")
DNI = plain_re.compile(r"(?<![\w.\-/+])(?:\d{8}|\d{2}\.\d{3}\.\d{3}|[XYZxyz][\- ]?\d{7})[\- ]?[A-Za-z](?![\w])")
OTHER_ID = plain_re.compile(r"(?<![\w.\-/+])(?=[A-Z0-9 .\-/]*\d)[A-Z]{0,4}[ \-]?\d(?:[ .\-/]?[A-Z0-9]){5,17}(?![\w])")

# Numbers of persons that are told by form and check digits: Luhn with a date of birth (Sweden, South Africa), mod 97 (France, Belgium).
CHECKED = plain_re.compile(
    r"(?<![\w.\-/+])(?:(?P<se>(?:19|20)?\d{6}[-+]\d{4})|(?P<za>\d{6} \d{4} [01]8\d|\d{10}[01]8\d)|(?P<be>\d\d\.\d\d\.\d\d-\d{3}\.\d\d)"
    r"|(?P<fr>[12] ?\d\d ?(?:0[1-9]|1[0-2]|[2-9]\d) ?(?:\d\d|2[AB]) ?\d{3} ?\d{3} ?\d\d))(?![\w]|[.\-/]\d)"
)

# A stretch of digits and what may stand between them: the forms above, with up to AROUND characters around it, are looked for there only.
CLUSTER, AROUND = plain_re.compile(r"[0-9][0-9 .\-/+AB]{4,}[0-9]"), 6

HOUSE = r"\d{1,5}(?:\s?[A-Za-z](?![\p{L}\d])|[\-/]\d{1,4})?"
WORD = r"[\p{Lu}][\p{L}’'\-]*"
EN_ADDRESS = re.compile(rf"(?<![\w.\-/+:,]){HOUSE} (?:(?:{WORD}|of|the) ){{1,4}}(?:{EN_WAYS}|(?i:{EN_WAYS}))\b(?![\w_])")
IB_ADDRESS = re.compile(rf"(?<![\p{{L}}\d_])(?i:{IBERIAN_WAYS})\s?(?:(?i:de|da|do|das|dos|del|la|las|los|el|e|y) |{WORD} ?){{1,7}},?\s?(?i:nº|n\.º|n°|núm\.|num\.|no\.|número|n\.)?\s?{HOUSE}(?![\w]|[.:\-/]\d)")
DE_ADDRESS = re.compile(rf"(?<![\w\-])(?:(?:(?:Am|An|Auf|Im|In|Zum|Zur|Unter|Hinter|Bei|Alte[rn]?|Neue[rn]?|Große[rn]?|Kleine[rn]?|Obere[rn]?|Untere[rn]?|der|dem|den|{WORD}) ){{0,3}})?(?:[\p{{Lu}}][\p{{L}}\-]*(?:{DE_WAYS})|[\p{{Lu}}]+(?i:{DE_WAYS})) {HOUSE}(?![\w]|[.:\-/]\d)")
# what an address of the kind must contain, in lower case
IB_WORDS = plain_re.compile(IBERIAN_WAYS.lower())
DE_WORDS = [w.lower().replace("\\", "") + " " for w in DE_WAYS.split("|")]
ADDRESS_BEFORE = re.compile(r"(?:\b(?:address|adresse|anschrift|dirección|direccion|endereço|endereco|domicilio|domicílio|morada|lives at|living at|mora (?:na|no|em)|vive en|wohnt|ship to|deliver to|entregar em|enviar a|lieferung an|lieferung|the tenant at|resides at|reside en|reside na|located at|visit)\b[\s:=\"']{0,4}(?:in der |an der |am |im )?|address\w*['\" ]{0,2}(?:=|:)\s?['\"])$", re.I)

PARTICLE = r"(?:d[aeo]s?|del|de la|de l[ao]s|von|van|di|du|der|zu)"
PART = r"(?:\p{Lu}\p{Ll}+(?:['’]\p{Lu}\p{Ll}+)?|\p{Lu}['’]\p{Lu}\p{Ll}+)(?:-\p{Lu}\p{Ll}+)*"
CAPS = r"\p{Lu}{2,}(?:['’-]\p{Lu}{2,})*"
NAME = re.compile(
    rf"(?<![\w.\-/@])(?<!\w['’])(?:(?:\p{{Lu}}\.[  ]?){{1,2}}(?:{PARTICLE}[  ]+)?{PART}(?:[  ]+(?:{PARTICLE}[  ]+)?{PART})*|(?:\p{{Lu}}\.[  ]?){{1,2}}{CAPS}(?:[  ]+{CAPS})?|(?:{PART}(?:[  ]+{PARTICLE})?[  ]+)+{PART}|{PART}(?:[  ]+(?:{PARTICLE}[  ]+)?{PART})?,[  ]+{PART}(?:[  ]{PART})?"
    rf"|(?:{CAPS}(?:[  ]+{PARTICLE.upper()}|[  ]+{PARTICLE})?[  ]+)+{CAPS}|{CAPS}(?:[  ]+{CAPS})?,[  ]+{CAPS})(?![\w_@]|\.\w)"
)
NAME_BEFORE = re.compile(
    r"(?:\b(?:dr|dra|eng|engª|engº|lic|ing|prof|profa|sr|sra|srta|mr|mrs|ms|miss|sir|d|dª|don|doña|frau|herrn?|dipl)\b\.?(?:-ing\.?)? ?"
    r"|(?:\b(?:author|autor|autora|owner|dono|dueño|responsável|responsable|bearbeiter|bearbeiterin|verantwortlich|ansprechpartner|assignee|reviewer|contact person|requester|cliente|customer|kunde|name|full name|nome|nombre|user)\b ?[:=] ?['\"]?)"
    r"|\b\w*(?:full_name|_name|nome\w*|nombre\w*|titular)['\"]? ?(?:=|:|like) ?N?['\"]"
    r"|\b(?:dear|hi|hello|reported by|requested by|spoke with|talked to|talk to|asked by|ask|signed by|written by|approved by|assigned to|met with|thanks to|falei com|solicitado por|pedido por|cadastro d[aeo]|ligar para|falar com|conversei com|prezad[oa]|olá|hablé con|hable con|pregunte a|lo pidió|la pidió|pedido de|solicitado por|estimad[oa]|hola|gemeldet von|gemeldet durch|gesprochen mit|sprach mit|rücksprache mit|liebe[r]?|hallo|sehr geehrte[r]?|erstellt von|freigegeben von) "
    r"|(?:\b(?:thanks|thank you|regards|best regards|kind regards|best|cheers|sincerely|atenciosamente|obrigad[oa]|abraços|att|cumprimentos|saludos|saludos cordiales|atentamente|gracias|un saludo|viele grüße|grüße|mit freundlichen grüßen|mfg|gruß|danke)[,.!]?\s{1,3}))$",
    re.I,
)
NAME_AFTER = re.compile(
    r"^(?:['\"]? as \w*name| (?:approved the|approved|signed off|confirmed|reported|asked|told|wrote to|lo confirmó|lo aprobó|confirmou|aprovou|pediu|foi corrigido|hat (?:das|es|den|die)|fragen|bestätigte|genehmigte|freigegeben|is on leave|ist im urlaub|está de férias|está de vacaciones)\b)",
    re.I,
)
# Keywords of SQL, articles, prepositions and pronouns of five languages, kinds of streets, months, and words of the cues themselves: none belongs to a name.
NOT_NAME = set(
    "select from where group order by having inner left right full outer cross join union insert update delete into values set case when then else end and or not null is in as on asc desc distinct top limit between like exists with "
    "count sum min max avg table view index query sql etl id row rows "
    "the a an this that these those who whoever use why "
    "el la los las un una o os as um uma de da do com por en na no não para que se der die das des mit seit "
    "street st road rd lane avenue close rua av avenida calle paseo "
    "january february march april may june july august september october november december mai "
    "dear hi hello bitte gemeldet ask call tel phone mob send reported requested thanks regards saludos atenciosamente falei solicitado hablé cadastro owner author contact address escalate whatsapp "
    "cpf ssn dni national insurance social security number version".split()
)


_NOT_DIGIT = plain_re.compile(r"\D+")
_RUN = plain_re.compile(r"[^\s,]+")
_PARTICLE = plain_re.compile(PARTICLE, plain_re.I)
_AREA = plain_re.compile(r"(?:\+\d+ ?)?\(\d{2,5}\) ?\d")
_COUNTED = plain_re.compile(r"(?:order|row|rpt-?|build|version|ticket|invoice|sum was|pedido|nota|sku|isbn|=|<|>|between|in \()\s*$", plain_re.I)
_DATE = plain_re.compile(r"(?:19|20)\d\d[\-/.]\d\d[\-/.]\d\d|\d\d[./]\d\d[./]\d{4}$")
_BARE = plain_re.compile(r"[_\[\]]$")


def _digits(s: str) -> str:
    return _NOT_DIGIT.sub("", s)


def luhn(s: str) -> bool:
    d = [int(c) for c in reversed(_digits(s))]
    return len(d) > 1 and sum(d[::2] + [sum(divmod(2 * x, 10)) for x in d[1::2]]) % 10 == 0


def mod97(s: str) -> bool:
    """The last two digits are 97 less the rest of the others by 97; the Corsican departments 2A and 2B count as 19 and 18."""
    d = _digits(s.replace("2A", "19").replace("2B", "18"))
    return len(d) > 2 and int(d[-2:]) == 97 - int(d[:-2]) % 97


def birth(s: str) -> bool:
    """Whether six digits can be year, month and day."""
    return 1 <= int(s[2:4]) <= 12 and 1 <= int(s[4:6]) <= 31


def checked(kind: str, s: str) -> bool:
    """Whether the check digits of a form fit; Belgian numbers from 2000 on are checked with a 2 in front."""
    if kind == "se":
        return birth(_digits(s)[-10:]) and luhn(_digits(s)[-10:])
    if kind == "za":
        return birth(s) and luhn(s)
    return mod97(s) or kind == "be" and mod97("2" + s)


def cpf_ok(s: str) -> bool:
    d = [int(c) for c in _digits(s)]
    if len(d) != 11 or len(set(d)) == 1:
        return False
    for n in (9, 10):
        r = sum(x * (n + 1 - i) for i, x in enumerate(d[:n])) * 10 % 11 % 10
        if r != d[n]:
            return False
    return True


def dni_ok(s: str) -> bool:
    t = re.sub(r"[^A-Z0-9]", "", s.upper())
    t = t.translate(str.maketrans("XYZ", "012"), ) if t[:1] in "XYZ" else t
    t = t[:-1] + s.strip()[-1].upper()
    return t[:-1].isdigit() and "TRWAGMYFPDXBNJZSQVHLCKE"[int(t[:-1]) % 23] == t[-1]


def _email(text):
    if not AT_SIGN.search(text):
        return
    for m in EMAIL.finditer(text):
        yield m.start(), m.end(), 9.0


def _phone(text):
    for m in PHONE.finditer(text):
        s = m[0]
        n = len(_digits(s))
        if n < 7 or n > 15:
            continue
        before, after = text[max(0, m.start() - BEFORE) : m.start()], text[m.end() : m.end() + AFTER]
        score = 0.0
        if s.startswith("+"):
            score += 3
        elif s.startswith("00"):
            score += 0.5
        if _AREA.match(s):
            score += 2.5
        if PHONE_BEFORE.search(before):
            score += 3
        if PHONE_AFTER.match(after):
            score += 3
        if ID_BEFORE.search(before):
            score -= 6
        if _COUNTED.search(before) and not s.startswith("+") and not PHONE_BEFORE.search(before):
            score -= 3
        if _DATE.match(s):
            score -= 4
        if score >= THRESHOLD or score >= 2.5 and s[0] == "(":
            yield m.start(), m.end(), max(score, THRESHOLD)


def _numbers(text, rx, clusters):
    """Matches of a form around the clusters of digits of a text."""
    for a, b in clusters:
        yield from rx.finditer(text, max(0, a - AROUND), min(len(text), b + AROUND))


def _ids(text):
    clusters = [c.span() for c in CLUSTER.finditer(text)]
    for rx, kind in ((SSN, "ssn"), (NINO, "nino"), (CPF, "cpf"), (DNI, "dni"), (OTHER_ID, "other")):
        for m in _numbers(text, rx, clusters) if kind != "other" else rx.finditer(text):
            s = m[0]
            cue = ID_BEFORE.search(text[max(0, m.start() - BEFORE - 16) : m.start()])
            score = 4.0 if cue else 0.0
            if kind == "nino":
                score += 3 if " " in s or s[:2].isupper() and s[-1].isupper() and len(s) == 9 else 0
            elif kind == "cpf":
                score += (2.5 if cpf_ok(s) else 1.0) + (1.5 if "." in s and "-" in s else -2.0)
            elif kind == "dni":
                score += 2.5 if dni_ok(s) else 0.0
                score += 1.0 if re.search(r"[A-Z]$", s) and not cue else 0.0
                if s[-1].islower() and not cue:
                    score -= 2
            elif kind == "ssn":
                score += 2.0 if s[3] == "-" else 0.5
            elif kind == "other" and cue:
                score -= 0.5
            if score >= THRESHOLD:
                yield m.start(), m.end(), score + 2
    for m in _numbers(text, CHECKED, clusters):
        if checked(m.lastgroup, m[0]) and not _COUNTED.search(text[max(0, m.start() - BEFORE) : m.start()]):
            yield m.start(), m.end(), THRESHOLD + 3


def _iberian(text, low):
    """Matches of IB_ADDRESS, tried where one of its words begins."""
    end = 0
    for w in IB_WORDS.finditer(low):
        if w.start() >= end and (m := IB_ADDRESS.match(text, w.start())):
            end = m.end()
            yield m


def _address(text):
    low = text.lower()
    found = [*EN_ADDRESS.finditer(text)]
    # letters whose lower case has another length shift the places
    found += _iberian(text, low) if len(low) == len(text) else IB_ADDRESS.finditer(text)
    found += DE_ADDRESS.finditer(text) if any(w in low for w in DE_WORDS) else []
    for m in found:
        yield m.start(), m.end(), 4.0 + (2 if ADDRESS_BEFORE.search(text[max(0, m.start() - BEFORE) : m.start()]) else 0)


def _name(text):
    at = 0
    while m := NAME.search(text, at):
        start, at = m.span()
        # names are read again between the common words of a run
        words = [(w.start() + start, w.end() + start) for w in _RUN.finditer(m[0])]
        cuts = [w for i, w in enumerate(words) if _plain(text[w[0] : w[1]]) and not (i and _particle(text, words, i))]
        if not cuts:
            yield from _name_at(text, start, at)
            continue
        for begin, (stop, _) in zip([start, *(b for _, b in cuts[:-1])], cuts):
            while part := NAME.search(text, begin, stop):
                begin = part.end()
                yield from _name_at(text, *part.span())
        last = NAME.search(text, cuts[-1][1])
        if last and last.start() < at and not _plain(_RUN.match(last[0])[0]):
            at = last.end()
            yield from _name_at(text, *last.span())


def _particle(text, words, i):
    """Whether a word of a name is a particle, la, las and los behind de included."""
    w = text[words[i][0] : words[i][1]]
    return bool(_PARTICLE.fullmatch(w)) or i > 0 and w.lower() in ("la", "las", "los") and text[words[i - 1][0] : words[i - 1][1]].lower() == "de"


def _name_at(text, start, end):
    s = text[start:end]
    words = [(w.start() + start, w.end() + start) for w in _RUN.finditer(s)]
    # a cue word or a common word may have been swallowed at either end
    while words and _plain(text[words[0][0] : words[0][1]]):
        words.pop(0)
    cut = next((i for i, (a, b) in enumerate(words) if _plain(text[a:b]) and not _particle(text, words, i)), None)
    if cut is not None:
        words = words[:cut]
    while words and _particle(text, words, len(words) - 1):
        words.pop()
    while words and _PARTICLE.fullmatch(text[words[0][0] : words[0][1]]):
        words.pop(0)
    known = [text[a:b].lower().split("-")[0] in GIVEN for a, b in words]
    if any(known[1:]) and not known[0] and "," not in text[start:end] and not NAME_BEFORE.search(text[max(0, words[0][0] - BEFORE) : words[0][0]]):
        words = words[known.index(True) :]
    if len(words) < 2:
        return
    start, end = words[0][0], words[-1][1]
    given = [text[a:b].lower().split("-")[0] in GIVEN for a, b in words]
    before, after = text[max(0, start - BEFORE) : start], text[end : end + AFTER]
    score = 0.0
    if NAME_BEFORE.search(before):
        score += 3
    if NAME_AFTER.match(after):
        score += 2
    if given[0]:
        score += 2
    elif any(given) and "," in text[start:end]:
        score += 2
    if score >= THRESHOLD:
        yield start, end, score
    elif given[0] and not _BARE.search(before):
        yield start, end, THRESHOLD


def _plain(w: str) -> bool:
    return w.lower().strip(".") in NOT_NAME


FINDERS = (("email", _email), ("phone", _phone), ("id_number", _ids), ("address", _address), ("name", _name))


def find_spans(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of each span, without overlap, in order."""
    if not text:
        return []
    found = [(score, b - a, -a, a, b, kind) for kind, f in FINDERS for a, b, score in f(text)]
    found.sort(reverse=True)
    taken: list[tuple[int, int, str]] = []
    import bisect

    starts: list[int] = []
    for _, _, _, a, b, kind in found:
        k = bisect.bisect_left(starts, a)
        if k and taken[k - 1][1] > a or k < len(taken) and taken[k][0] < b:
            continue
        starts.insert(k, a)
        taken.insert(k, (a, b, kind))
    return taken


def redact(text: str | None) -> str | None:
    """The text with each span replaced by [KIND]."""
    if not text:
        return text
    out, at = [], 0
    for a, b, kind in find_spans(text):
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join(out) + text[at:]


SPANS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("found", T.StringType())])


def _spans(batches):
    import pandas as pd

    for batch in batches:
        seen: dict[str, list] = {}
        out = []
        for i, t in zip(batch["doc_id"].tolist(), batch["text"].tolist()):
            if not t:
                continue
            if t not in seen:
                seen[t] = sorted({(k, t[a:b]) for a, b, k in find_spans(t)})
            out += [(i, k, f) for k, f in seen[t]]
        yield pd.DataFrame(out, columns=SPANS.names).astype({"doc_id": "int64"})


@F.pandas_udf(T.StringType())
def _redacted(texts):
    import pandas as pd

    return pd.Series([redact(t) for t in texts], dtype=object)


def personal_spans(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, kind, found: one row per distinct span text of a document. A narrow map; no shuffle. Rows with a null key are left out."""
    rows = spread(df.where(F.col(key).isNotNull() & (F.length(text) > 0)).select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")))
    return rows.mapInPandas(_spans, SPANS)


def redacted(text: Column) -> Column:
    """The text with typed placeholders; null and empty stay as they are."""
    return _redacted(text)
