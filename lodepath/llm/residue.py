"""Template marks never filled in, filler, error messages and notices that scripts are needed.

Two detectors look at whole texts. Template marks are found by their delimiters, given as one pattern, and
judged by what stands in them and by the sentence around. Phrases of filler, errors and script notices, in
four languages, are found by a multi-pattern automaton (Aho-Corasick); a passage is residue if what the
phrases and their supporting words cover is nearly all of it, and at least one phrase is a telling one. So
a sentence that merely mentions an error or JavaScript, with words of its own, is not.

Coverage is taken of each sentence, not of the document as a whole: a notice amid real sentences counts too.
"""

from __future__ import annotations

import html
import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

#: Share of a sentence's letters and digits that matches must cover.
COVERAGE = 0.8

# --- fixed values: phrases that tell, by kind; plain text, words in lower case, 0 for any number ---
SCRIPT_PHRASES = """
enable javascript|javascript must be|needs javascript|requires javascript|turn on javascript|switch on javascript|activate javascript|allow javascript|javascript is disabled
javascript is turned off|javascript is switched off|javascript is not enabled|javascript is off|javascript disabled|without javascript|javascript to|scripting is disabled|scripts are disabled
does not run client side code|client side code|scripts are blocked|scripts are required|scripts are needed|activate scripts|allow scripts|enable scripts|turn on scripts|blocks scripts|support the scripts|support javascript|needs scripts
checking your browser|verify that you are human|verify you are human|are you a robot|not a robot|enable cookies|cookies are disabled
aktivieren sie javascript|javascript aktivieren|javascript ist ausgeschaltet|javascript ist deaktiviert|javascript muss|ohne javascript|skripte benötigt|skripte werden|skripte sind|skripte blockiert
blockiert skripte|benötigt javascript|javascript einschalten|schalten sie javascript|skripte aktivieren|führt sie nicht aus|javascript wird benötigt|javascript erforderlich
activer javascript|activez javascript|javascript est désactivé|javascript doit être|sans javascript|scripts nécessaires|bloque les scripts|nécessite javascript|javascript est nécessaire|autoriser les scripts|autorisez les scripts|activez les scripts
activa javascript|activar javascript|active javascript|javascript está desactivado|javascript debe|sin javascript|bloquea los scripts|necesita javascript|requiere javascript|habilite javascript|habilita javascript|permite los scripts|activa los scripts|javascript para ver
""".strip()  # fmt: skip
ERROR_PHRASES = """
access denied|not currently accessible|unexpected condition|unexpected error|domain has been parked|domain is parked|domain is for sale|permission to view|not found|page not found|cannot be displayed|could not be displayed|cannot be shown|could not be shown|could not be found|could not be taken|could not be removed|has moved or was|was taken away|no longer available|page has moved|page was removed
internal server error|server error|service unavailable|temporarily unavailable|gateway timeout|bad gateway|bad request|forbidden|unauthorized|too many requests|unhandled exception|did not answer within|down for maintenance|under maintenance|session has expired|session expired
something went wrong|an error occurred|an error has occurred|could not render|could not finish|could not complete|could not load|failed to load|try again later|try again in|request blocked|connection refused|connection timed out|connection failed|stack trace|null reference|nullreference|error 0|oops
could not connect|cannot connect|unable to connect|connect to database|database error|query failed|fatal error|syntax error|out of memory|segmentation fault|no such file|timed out|deadline exceeded|host unreachable|errno 0|uncaught exception|access to this page|has been blocked|too busy|overloaded|rate limit exceeded|we ll be back|be right back
zugriff verweigert|nicht gefunden werden|nicht gefunden|ist ein fehler aufgetreten|fehler aufgetreten|fehler 0|nicht verfügbar|wartungsarbeiten|sitzung ist abgelaufen|sitzung abgelaufen|erneut versuchen|versuchen sie es|kann nicht angezeigt werden|konnte nicht geladen werden|zu viele anfragen|interner serverfehler|keine verbindung|verbindung zur datenbank|zeitüberschreitung|vorübergehend nicht|nicht erreichbar|seite existiert nicht|technischer fehler
accès refusé|page introuvable|introuvable|erreur 0|indisponible|erreur est survenue|erreur s est produite|session a expiré|trop de requêtes|réessayez|veuillez réessayer|en maintenance|ne peut pas être affichée|n existe plus|erreur interne|n a pas pu être|connexion impossible|impossible de se connecter|base de données|délai dépassé|erreur technique|page demandée
acceso denegado|no se encontró|error 0|no disponible|se ha producido un error|ha ocurrido un error|vuelve a intentarlo|inténtalo de nuevo|sesión ha caducado|sesión ha expirado|demasiadas solicitudes|no se puede mostrar|mantenimiento código|no se ha encontrado|error interno|por mantenimiento|no se pudo conectar|base de datos|tiempo de espera agotado|error técnico|página solicitada|no se pudo cargar|no existe
""".strip()  # fmt: skip
FILLER_PHRASES = """
dummy text|placeholder for|placeholder text|sample paragraph|sample text|body copy goes here|text goes here|copy goes here|content goes here|description goes here|description to follow|details to follow|text to follow|to be added|to be completed|insert text here|your text here|replace before going live|coming soon|add text here|enter text here|description pending|description here|no description yet|to be announced|to be confirmed|work in progress
blindtext|beschreibung folgt|text folgt|platzhalter|platzhaltertext|beispieltext|mustertext|hier steht später|text einfügen|inhalt folgt|hier kommt der text|fülltext|beschreibung fehlt|wird noch ergänzt|wird nachgereicht|in bearbeitung|text kommt
texte factice|texte ici|votre texte|faux texte|texte de remplissage|texte à venir|description à venir|texte provisoire|contenu à venir|insérez votre texte|ici le texte|description en attente|à compléter|en cours de rédaction|contenu ici|bientôt disponible
texto de relleno|aquí va el texto|texto de ejemplo|texto provisional|descripción próximamente|texto aquí|tu texto|inserte texto|contenido próximamente|texto pendiente|descripción pendiente|contenido pendiente|por completar|en construcción|muy pronto
""".strip()  # fmt: skip
#: Words that such passages are made of; they help to cover a sentence but tell nothing by themselves.
SUPPORT_WORDS = """
a an and or the to of in on at by for from with this that these it its is are was be been has have had do does not no you your we our us i if then so before after until once more again later within when while all any some must need needs cannot could can will may
please enable allow activate turn switch reload refresh retry continue return go back try see view read open opening show shown display load loading complete finish render answer respond wait support block blocked expired moved removed taken away
javascript cookies script scripts scripting browser browsers page pages site website app application window tab network server servers service request requests requested response connection session system security ticket reference code line error errors status upstream gateway timeout bad
job jobs posting vacancy vacancies advert ad listing offer offers role roles position careers career portal search results content text section duties layout preview paragraph sample live going replace sign signed in human verify checking asked seconds minutes hours happens nothing something went wrong tried sorry oops permission ask exist exists url address link
at render postingview nullreference exception unhandled connect database postings errno host memory file line php uncaught fatal warning busy api query sql html body http https www 0 menu home saved alerts skip terms privacy help
bitte sie es um zu die der das den dem diese dieser dieses ist sind wird werden wurde kann konnte nicht ein eine einen und oder für ihr ihre ihrem auf in bis von zur zum später erneut minuten sekunden uhr zurzeit dienst seite stellenanzeige anzeige stelle stellentext text sehen laden lässt sich benötigt browser skripte fehler verbindung datenbank beschreibung inhalt vorgang vorschau dies hier steht folgt anfrage neu führt aus
veuillez pour afficher voir cette ce ces le la les un une de des du d l n à en et ou est pas ne sans votre vos page offre offres poste texte pour maquette ceci ici fonctionne navigateur service momentanément erreur code réessayer dans minutes plus tard bloque nécessaires lire recharger base données connexion description contenu la
para ver la el los las un una de del que es este esta esto en no se por favor tu su página oferta ofertas puesto texto maqueta aquí va navegador servicio código minutos segundos necesita mostrar puede intentarlo vuelve más tarde y o recarga leer solicitud conectar base datos descripción contenido
""".strip()  # fmt: skip
#: Words of the customary filler in Latin.
LATIN = set(
    "lorem ipsum dolor sit amet consectetur consectetuer adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split()
)
#: What stands in the slots of posting templates: heads of such names in four languages, without accents.
SLOT_WORDS = set(
    "company companyname employer job jobtitle title position role department team location city site address salary range pay rate compensation benefits start startdate date contact email phone hiring manager recruiter req reqno requisition shift hours schedule name firstname lastname service client brand office country state website deadline skills duties experience contract "
    "firma firmenname unternehmen stelle stellenbezeichnung stellentitel abteilung standort ort gehalt gehaltsspanne eintrittsdatum startdatum ansprechpartner ansprechpartnerin kontakt telefon vorname nachname arbeitszeit "
    "entreprise nomentreprise nom poste intitule intituledeposte intituleduposte service departement lieu ville salaire debut datededebut contact courriel responsable horaires "
    "empresa nombre puesto nombredelpuesto departamento ubicacion lugar ciudad salario sueldo fecha inicio fechadeinicio contacto correo responsable turno horario".split()
)
#: Words that tell whoever fills in a template to do so.
FILL_WORDS = set("insert add enter your todo tbd tbc fill put type here replace please specify provide bitte angeben veuillez indiquer indique indicar hier einfugen eintragen ihr ihre erganzen inserer ajouter votre saisir completer insertar anadir su tu introducir rellenar completar".split())
#: In a sentence with one of these, marks are what the sentence is about.
TALK = re.compile(
    r"\b(?:templates?|snippets?|placeholders?|modules?|marks?|tags? such|log call|syntax|variables?|mustache|brackets?|our stack|tokens?|merge fields?|vorlagen?|platzhaltern?|modèles?|balises?|gabarits?|plantillas?|marcadores|etiquetas como|faults?|bugs?)\b",
    re.I,
)

_HTML_NAMES = (
    "a abbr address article aside b blockquote body br button caption center cite code col colgroup dd del details dfn div dl dt em figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main mark meta nav noscript ol option p pre q s samp script section select small span strike strong style sub summary sup svg table tbody td textarea tfoot th thead time title tr tt u ul var video"
).split()
_HTML = re.compile(r"</?(?:" + "|".join(_HTML_NAMES) + r")(?:\s+[^<>]*=[^<>]*|\s*/?)>|<!--.*?-->|<!doctype[^>]*>", re.I | re.S)
_NAME = r"[^\W\d_][\w .\-’']*+"
#: Delimiters of template marks. strong: hardly anything else; weak: brackets that people also use.
#: What stands in a mark may be of any length: no class holds its own delimiter, so the possessive runs end there.
_STRONG = re.compile(
    r"\{\{\{?\s*+(?P<s1>[^{}]*+)\}?\}\}|\$\{\s*+(?P<s2>[^{}]++)\}|<%[=\-]?\s*+(?P<s3>[^%<>]++)%>|\{%\s*+(?P<s4>[^%{}]++)%\}|\[\[\s*+(?P<s5>[^\[\]]++)\]\]"
    r"|<<\s*+(?P<s6>[^<>]++)>>|«\s*+(?P<s7>\w{2,}+)\s*+»|%\(\s*+(?P<s8>\w++)\s*+\)[sdif]|\*\|\s*+(?P<s9>[\w:]++)\s*+\|\*|@@\s*+(?P<s10>\w++)\s*+@@|@Model\.(?P<s11>\w++)"
    r"|(?<![\w%])%(?P<s12>[A-Z][A-Z0-9_]++)%|(?<!\w)__(?P<s13>[A-Z][A-Z0-9_]+?)__(?!\w)|(?<![\w$])\$(?P<s14>[A-Z][A-Z0-9_]++)\$|(?<![\w#])\#(?P<s15>[A-Z][A-Z0-9_]++)\#|(?<![\w:]):(?P<s16>[A-Z][A-Z0-9_]++):"
)
_WEAK = re.compile(rf"\[\s*(?P<w1>{_NAME}(?::[^\[\]]*+)?)\s*\]|\(\s*(?P<w2>{_NAME}(?::[^()]*+)?)\s*\)|(?<![{{$])\{{\s*(?P<w3>{_NAME}|\d)\s*\}}|<\s*(?P<w4>{_NAME}(?::[^<>]*+)?)\s*>|_{{4,}}")
_BARE = re.compile(r"\[object Object\]|(?<!['\"‘“\w])undefined(?!['\"’”\w])(?! is not a\b)|\bXXXX+\b|(?<!\w)NaN(?!\w)")
_SPLIT = re.compile(r"(?<=[.!?…])[\"'”»)]*\s+|\n+|\s[|·•]\s|\t+")
_KEEP = re.compile(r"[^\W_]+")
_ROWS = re.compile(r"^(?:[asdfghjklöäüñ]+|[qwertzyuiopü]+|[yxcvbnm]+)$")


def fold(s: str) -> str:
    """Without accents and case."""
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).casefold()


def _names(inner: str) -> list[str]:
    """The words of a slot's name: first_name, FirstName and 'first name' alike."""
    inner = re.sub(r"(?<=[a-zà-ÿ])(?=[A-Z])", " ", inner)
    return [fold(w) for w in re.findall(r"[^\W_]+", inner)]


def _is_slot(inner: str, weak: bool) -> bool:
    names = _names(inner)
    if not names:
        return False
    if names[0] in FILL_WORDS or names[-1] == "here":
        return len(names) > 1 or names[0] in ("todo", "tbd", "tbc")
    small = {"de", "du", "des", "del", "la", "le", "d", "of", "the", "no", "if", "endif", "for", "end", "else", "first", "last"}
    known = [w in SLOT_WORDS for w in names if w not in small]
    return bool(known) and all(known) and (not weak or len(names) <= 4)


class _Automaton:
    """Finds all phrases and words, on word bounds, in one pass."""

    def __init__(self, telling: dict[str, str], support: set[str]):
        try:
            import ahocorasick

            self.find = None
            self.auto = ahocorasick.Automaton()
            for p, kind in telling.items():
                self.auto.add_word(f" {p} ", (len(p), kind))
            for w in support:
                if w not in telling:
                    self.auto.add_word(f" {w} ", (len(w), ""))
            self.auto.make_automaton()
            self.find = lambda s: self.auto.iter(s)
        except ImportError:  # the same matches from a plain table, phrase lengths bounded
            table = {p: (len(p), k) for p, k in telling.items()} | {w: (len(w), "") for w in support if w not in telling}
            longest = max(p.count(" ") + 1 for p in table)

            def find(s: str):
                ws, at = s.split(" ")[1:-1], 1
                for i, w in enumerate(ws):
                    piece, end = "", at - 1
                    for x in ws[i : i + longest]:
                        piece, end = (f"{piece} {x}" if piece else x), end + len(x) + 1
                        if piece in table:
                            yield end, table[piece]
                    at += len(w) + 1

            self.find = find

    def cover(self, words: list[str]) -> tuple[float, set[str]]:
        """Share of the words' letters covered, and the kinds of the telling phrases."""
        s = " " + " ".join(words) + " "
        taken = bytearray(len(s))
        kinds = set()
        for end, (n, kind) in self.find(s):
            taken[end - n : end] = b"\1" * n
            if kind:
                kinds.add(kind)
        letters = sum(map(len, words))
        blanks = sum(1 for i, c in enumerate(s) if c == " " and taken[i])
        return (sum(taken) - blanks) / max(1, letters), kinds


@lru_cache(1)
def automaton() -> _Automaton:
    split = lambda block: [p.strip() for line in block.splitlines() for p in line.split("|") if p.strip()]
    telling = {p: kind for kind, block in (("script", SCRIPT_PHRASES), ("error", ERROR_PHRASES), ("filler", FILLER_PHRASES)) for p in split(block)}
    return _Automaton(telling, set(SUPPORT_WORDS.split()))


_NUMBER = re.compile(r"(?=[a-f]*[0-9])[0-9a-f]+")


def _words(s: str) -> list[str]:
    """Words in lower case; numbers, and codes of hexadecimal digits, as 0."""
    return ["0" if w[0] <= "f" and _NUMBER.fullmatch(w) else w for w in _KEEP.findall(s.replace("’", " ").casefold())]


def _runs(words: list[str]) -> str | None:
    """Filler by its shape: Latin filler, one word over and over, keys struck at random."""
    latin = same = keys = 0
    for i, w in enumerate(words):
        latin = latin + 1 if w in LATIN else 0
        same = same + 1 if i and w == words[i - 1] and not w.isdigit() else 0
        keys = keys + 1 if len(w) > 2 and _ROWS.match(w) else 0
        if latin >= 4 or same >= 3 or keys >= 6:
            return "filler"
    return None


#: Some of these stand in every template mark.
_HINT = re.compile(r"[{}\[\]<>«»@$#%*]|\(\w|__|:[A-Z]|undefined|XXXX|NaN")


def _marks(sentence: str) -> bool:
    if not _HINT.search(sentence):
        return False
    talk = TALK.search(sentence)
    for m in _STRONG.finditer(sentence):
        inner = next((g for g in m.groups() if g is not None), "")
        if _is_slot(inner, weak=False) or (inner and not talk and _names(inner)):
            return True
    for m in _WEAK.finditer(sentence):
        inner = next((g for g in m.groups() if g is not None), None)
        if inner is None:  # a line to fill in
            if not talk:
                return True
        elif inner.isdigit():
            if not talk:
                return True
        elif _is_slot(inner, weak=True):
            bracket = m.group()[0]
            names = _names(inner)
            told = names[0] in FILL_WORDS
            upper = inner.upper() == inner
            if told or bracket == "{" or (bracket == "<" and not talk) or (bracket == "[" and (upper or ":" in inner) and not talk):
                return True
    return bool(_BARE.search(sentence)) and not talk


def passages(text: str) -> list[str]:
    """Sentences and lines of a text, tags taken out, entities decoded."""
    text = html.unescape(_HTML.sub("\n", text))
    return [s for s in (p.strip() for p in _SPLIT.split(_HTML.sub("\n", text))) if s]


def residue(text: str | None) -> list[tuple[str, str]]:
    """(kind, passage) of each passage of text that is residue; nothing for null and empty text."""
    if not text:
        return []
    auto, out = automaton(), []
    for s in passages(text):
        if _marks(s):
            out.append(("template", s))
            continue
        words = _words(s)
        if not words:
            continue
        kind = _runs(words)
        if kind is None:
            share, kinds = auto.cover(words)
            if kinds and share >= COVERAGE:
                kind = min(kinds)
        if kind:
            out.append((kind, s))
    return out


def _find(batches):
    schema = pa.schema([("id", pa.int64()), ("kinds", pa.list_(pa.string())), ("passages", pa.list_(pa.string())), ("coverage", pa.float64())])
    for batch in batches:
        out = []
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = residue(text)
            if found:
                out.append((i, sorted({k for k, _ in found}), [p for _, p in found], sum(len(p) for _, p in found) / len(text)))
        cols = list(zip(*out, strict=True)) if out else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types, strict=True)], schema=schema)


def find_residue(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, kinds, passages, coverage) of the rows whose text holds residue; coverage is its share of the text.

    One pass, no shuffle. Null and empty texts hold none; other columns of df are not read; repeated ids give repeated rows.
    """
    return spread(df.select(F.col(id_col).cast("long").alias("id"), F.col(text))).mapInArrow(_find, "id long, kinds array<string>, passages array<string>, coverage double")
