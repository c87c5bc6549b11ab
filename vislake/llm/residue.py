"""Template residue, filler text, error pages and scripts-required notices (problem 9).

Records are cut into lines (line ends, separators of page furniture; sentences with evidence are lines of their own), the
lines are normalised and counted by host over all different texts, and those that recur beside content are subtracted: menus, titles, footers,
whatever they say. The residual decides: a record is a case if evidence (filler, error phrases, notices about scripts)
makes up at least LEAST_SHARE of it, or if a placeholder stands in it. Only hashes of lines are shuffled.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vislake.session import cut, spread

#: A line recurs if at least this many different texts of the host have it ...
RECURRENT_TEXTS = 3
#: ... and at least this share of them, so that a line that recurs by chance in a large corpus stays content.
RECURRENT_SHARE = 0.001
#: A recurrent line with evidence is boilerplate if at least this share of its texts have content of their own ...
BESIDE_CONTENT = 0.8
#: ... that is, lines of this length together that neither recur nor are evidence.
OWN_CHARS = 80
#: Share of evidence in the residual from which a record is a case.
LEAST_SHARE = 0.4

PLACEHOLDER, FILLER, ERROR, SCRIPT = "placeholder", "filler", "error", "script"

# --- placeholders ---------------------------------------------------------------------------------------------------

_LABEL = r"[^\W\d][\w\s.:-]{0,60}?"
_WIDE = r"[^{}<>%]{1,60}?"
#: Elements of page markup, which are not placeholders in angle brackets.
_TAGS = r"/?(?:html|head|body|title|h\d|div|p|center|br|hr|span|a|b|i|u|em|strong|table|thead|tbody|tr|td|th|ul|ol|li|pre|code|img|font|script|noscript|style|meta|link|nav|footer|header|section|article|main|form|input|button|label)\b[^<>]*"

_FORMS = re.compile(
    "|".join(
        (
            rf"\{{\{{\{{?\s*{_WIDE}\s*\}}?\}}\}}",  # {{x}}, {{{x}}}, {{x|default}}
            rf"\{{%-?\s*{_WIDE}\s*-?%\}}",  # {% x %}
            rf"<%[=-]?\s*{_WIDE}\s*%>",  # <%= x %>
            rf"\$\{{{_WIDE}\}}",  # ${x}, ${x:-}
            rf"\#\{{{_WIDE}\}}",  # #{x}
            rf"(?<![\w\\}}$\#{{])\{{(?:{_LABEL}|\d*)\}}(?!\}})",  # {x}, {0}, {}
            rf"｛{_WIDE}｝",
            rf"@@{_WIDE}@@",
            rf"~{{1,2}}{_LABEL}~{{1,2}}",
            rf"(?<![\w:])::{_LABEL}::(?![\w:])",
            rf"%\({_WIDE}\)[sdf]",  # %(x)s
            r"(?<![\w%])%(?:\d+\$)?[-+0]?\d*(?:\.\d+)?[sdif](?![\w%])",  # %s, %1$s, %.2f
            r"(?<![\w%])%[^\W\d][\w.]{0,40}%(?!\w)",  # %x%
            r"(?<![\w$\\])\$[^\W\d][\w.]{0,40}\$(?!\w)",  # $x$
            rf"(?<!\w)__{_LABEL}__(?!\w)",
            r"(?<![\w_])_{3,}(?![\w_])",
            rf"(?<![\w\])\[])\[\[\s*{_LABEL}\s*\]\](?!\])",  # [[x]], not an index c[[0]]
            rf"(?<![\w\])\[])\[(?:{_LABEL}|…|\.\.\.)\](?![\](])",  # [x], [your x], […]; not a link or an index
            rf"<!--\s*{_WIDE}\s*-->",
            rf"<<\s*{_LABEL}\s*>>",
            rf"<(?!{_TAGS}>)(?:{_LABEL}|…|\.\.\.)>",
            rf"«{_LABEL}»",
            r"\?{3,}",
            r"\b(?:TBD|TBA|TBC|TODO|FIXME|X{3,})\b",
        )
    )
)
#: Every form begins with one of these.
_MARKS = re.compile(r"[{<\[%$#@~_«｛]|::|\?{3}|TB[DAC]|TODO|FIXME|X{3}")
#: Stretches in which a form is spoken of: code, quotations.
_QUOTED = re.compile(r"`[^`\n]{0,200}`|\"[^\"\n]{0,120}\"|“[^”\n]{0,120}”|„[^“”\n]{0,120}[“”]|‘[^’\n]{0,80}’|(?<!\w)'[^'\n]{1,60}'(?!\w)")
#: Words right before a form that make it the subject.
_SPOKEN_OF = re.compile(r"(?:\b(?:written|spelt|spelled|typed|shown) (?:as|like)|\bmark(?:ed|ers?)|\breads?|\bcalled|\bnamed|\blabel(?:l?ed)?|\bplaceholders?|\bvariables?|\btokens?|\bstrings?|\btags?|\bliteral|\bpattern|\bsyntax|\bsymbols?|\bform of|\bmarqu\w+|\bécrit\w*|\bbalises?|\bvariables?|\bgeschrieben(?: als)?|\bmarkiert(?: mit)?|\bPlatzhalter|\bVariable|\bescrit\w+(?: como)?|\bmarcad\w+(?: con)?|\bvariable|\bmarcadores?)\s*[:(]?\s*$", re.I)
#: A formula or code around the form.
_CODE_BEFORE = re.compile(r"(?:\\\w+(?:\{[^{}]*\})*|[=(,]\s?\w*|\bf)$")
_CODE_AFTER = re.compile(r"^\s?(?:\s(?:means?|stands? for|denotes?|is replaced|are replaced|is filled|bedeutet|steht für|signifie|significa)\b)", re.I)


def placeholders(text: str) -> list[str]:
    """Forms that stand where a value should stand; not those that are quoted, code or the subject of the sentence."""
    return forms(_spaced(_plain(text)))


def forms(text: str) -> list[str]:
    """The same of a text whose characters and white space are normalised; markup is still in it."""
    if not _MARKS.search(text):
        return []
    quoted = None
    out, reach = [], 0
    for mark in _MARKS.finditer(text):
        m = _FORMS.match(text, mark.start()) if mark.start() >= reach else None
        if m is None:
            continue
        a, b = m.span()
        reach = b
        if quoted is None:
            quoted = [q.span() for q in _QUOTED.finditer(text)]
        if any(x < a and b < y for x, y in quoted):
            continue
        before, after = text[max(0, a - 60) : a], text[b : b + 40]
        if _SPOKEN_OF.search(before) or _CODE_AFTER.search(after) or (m.group()[0] in "{[" and _CODE_BEFORE.search(before)):
            continue
        out.append(m.group())
    return out


# --- filler, error pages, notices -----------------------------------------------------------------------------------
#
# General vocabulary of dummy text, of error pages and of notices about scripts in English, German, French
# and Spanish. Phrases are built from word classes; none of them names anything of a certain site or subject.

#: Words of the usual dummy Latin (other words go by their form).
LATIN = frozenset("lorem ipsum dolor sit amet consectetur consectetuer adipiscing elit sed eiusmod tempor incididunt ut labore et dolore magna aliqua enim minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum donec vestibulum integer tempus porta".split())
LATIN_SURE = LATIN - frozenset("sit sed et ut ex ea eu non qui id est tempus porta esse nulla sint anim magna".split())
#: Endings of Latin words; those of the second kind are as common in living languages and count half.
_LATIN_END = re.compile(r"(?:[ui]s|[aeiu]m|[aei]t|nt|[aou]r|ae|que)$")
_WEAK_END = re.compile(r"(?:[aeiou]|[aeo]s|[aeiou][nl])$")
#: Endings that words of living languages seldom have.
_LATIN_SURE_END = re.compile(r"(?:um|am|ae|que|ibus|tur|amus|unt|tis)$")
#: A sentence without a known word is dummy Latin by its form if it has this many words, two of them of the usual list or with sure endings.
LATIN_WORDS = 6
#: Function words of the four languages that are no Latin: hardly a sentence does without, and dummy Latin has none.
LIVING = frozenset("the of and to is was were are be been has have had this that these those with for from by on at as or not no but if it its we you your our they their he she which when after before while until than then so also only all both each more most der die das den dem des ein eine einer eines einem einen und oder nicht ist sind war waren wird werden wurde wurden mit von vom zu zum zur auf für bei nach im am als auch aus dass sie er es wir ich kein keine le la les un une du des au aux ce cette ces et il elle nous vous ils pour par sur dans avec sans est sont était pas plus que qui el los las unos unas del al y o en con por para su sus lo como es son fue fueron más".split()) - LATIN
#: A text with a larger share of function words and without any dummy word is not looked at for dummy Latin.
LIVING_SHARE = 0.12
#: Meaningless words people put where text should stand; runs along a keyboard row and of one letter go by rule.
MASH = frozenset("foo bar baz qux quux blah bla test testing dummy abc xyz".split())
_ROWS = ("qwertyuiop", "qwertzuiopü", "azertyuiop", "asdfghjklöä", "qsdfghjklm", "zxcvbnm", "yxcvbnm", "abcdefghijklmnopqrstuvwxyz")

_DET = r"(?:your |a |an |the |some |any |ihren? |einen? |der |den |dem |die |das |un |une |le |la |el |los |las |su |sus |tu |votre |vos |du |del )?"
_TEXT = r"(?:text|title|heading|headline|summary|description|paragraph|content|caption|copy|body copy|überschrift|titel|inhalt|beschreibung|texte|titre|contenu|résumé|légende|texto|título|contenido|resumen|descripción)"
_PUT = r"(?:insert|enter|add|write|type|put|replace|overwrite|saisissez|insérez|ajoutez|écrivez|remplacez|escriba|introduzca|inserte|añada|sustituya|ersetzen sie|schreiben sie)"
_SHAM = r"(?:dummy|sample|filler|example|placeholder|mock)"
_FILLER = (
    rf"\b{_SHAM} (?:{_TEXT}|entry)\b", rf"\b{_PUT} {_DET}{_TEXT}\b", rf"\b{_DET}{_TEXT} (?:goes|comes|belongs|will be) here\b", rf"\b{_TEXT} (?:to follow|coming soon|to come)\b", r"\bcoming soon\b", r"\bplease (?:overwrite|replace)\b", r"\bis a placeholder\b", r"\bheading (?:one|two|three|\d)\b", r"\bdo not publish\b", r"\bfor layout\b", r"\blayout purposes\b",
    r"\b(?:blind|platzhalter|beispiel|muster|füll)text\b", rf"\bhier (?:steht|kommt|folgt) (?:später |bald )?{_DET}{_TEXT}\b", rf"\b{_TEXT} (?:hier )?(?:eingeben|einfügen|ersetzen)\b", r"\bbitte (?:ersetzen|überschreiben)\b", r"\b(?:inhalt|text) folgt\b",
    r"\bfaux texte\b", rf"\b{_TEXT} (?:d.exemple|fictif|factice)\b", rf"\b{_DET}{_TEXT} ici\b", rf"\b{_TEXT} à (?:venir|remplacer)\b", r"\bpour la mise en page\b",
    rf"\b{_TEXT} de (?:ejemplo|relleno|muestra|prueba)\b", rf"\baquí va {_DET}{_TEXT}\b", rf"\b{_TEXT} (?:próximamente|aquí)\b", r"\bpara sustituir\b", r"\bpara la maqueta\b",
)
_SCRIPT_WORD = r"(?:java ?scripts?|js|scripts?|scripting|skripte?n?)"
_NOTICE = (
    rf"\b(?:enable|activate|activating|allow|turn on|switch on|permit)\b[^.!?]{{0,20}}\b{_SCRIPT_WORD}\b",
    rf"\b{_SCRIPT_WORD}\b[^.!?]{{0,40}}\b(?:must be|has to be|have to be|needs to be|need to be|is|are|should be) (?:allowed|enabled|activated|switched on|turned on|disabled|turned off|switched off|blocked|required|needed|off)\b",
    rf"\b(?:requires?|needs?|works? only with|only works with|works? best with)\b[^.!?]{{0,12}}\b{_SCRIPT_WORD}\b",
    rf"\b(?:does not support|blocks?|disabled|without)\b[^.!?]{{0,16}}\b{_SCRIPT_WORD}\b",
    r"\bnoscript\b", rf"\b{_SCRIPT_WORD}\b[^.!?]{{0,30}}\bto continue\b", r"\b(?:browser|connection) is being (?:tested|checked|verified)\b", r"\b(?:checking|verifying) your (?:browser|connection)\b",
    rf"\b(?:aktivieren|erlauben|einschalten)\b[^.!?]{{0,12}}\b{_SCRIPT_WORD}\b", rf"\b(?:ohne|benötigt|braucht|erfordert|blockiert|unterstützt)\b[^.!?]{{0,12}}\b{_SCRIPT_WORD}\b", rf"\b{_SCRIPT_WORD}\b[^.!?]{{0,20}}\b(?:aktivieren|deaktiviert|blockiert|erforderlich)\b",
    rf"\b(?:activer|activez|autoriser|autorisez)\b[^.!?]{{0,12}}\b{_SCRIPT_WORD}\b", rf"\b(?:nécessite|exige|requiert|sans)\b[^.!?]{{0,12}}\b{_SCRIPT_WORD}\b", rf"\b{_SCRIPT_WORD}\b[^.!?]{{0,20}}\b(?:bloqués?|désactivés?|requis|nécessaires?)\b",
    rf"\b(?:active|activar|habilite|permita)\b[^.!?]{{0,12}}\b{_SCRIPT_WORD}\b", rf"\b(?:necesita|requiere|exige|sin)\b[^.!?]{{0,12}}\b{_SCRIPT_WORD}\b", rf"\b{_SCRIPT_WORD}\b[^.!?]{{0,20}}\b(?:desactivados?|bloqueados?|necesarios?)\b",
)
#: Reason phrases of the public HTTP status codes.
_STATUS = r"(?:not found|forbidden|gone|internal server error|bad gateway|service unavailable|service temporarily unavailable|gateway time-?out|unauthori[sz]ed|too many requests|not acceptable|bad request|request time-?out|method not allowed|payment required|not implemented|conflict|length required|precondition failed|moved permanently|proxy authentication required)"
_ERROR = (
    rf"\b[1-5]\d\d\b\s*[-–:|]?\s*{_STATUS}\b", rf"\b(?:http|error|status)(?:/\d\.\d)?\s*(?:status|error|code)?\s*[:#-]?\s*\d{{3}}\b(?:\s*[-–:]\s*{_STATUS})?", rf"^\s*{_STATUS}\s*$", r"\berror (?:code )?(?:0x[0-9a-f]{1,40}|\d{1,40})\b",
    r"\b(?:page|file|resource|document|url) (?:was |could |can )?(?:not|no longer)(?: be)? (?:found|available|exist)\b", r"\b(?:resource|page|document) (?:is|was) no longer available\b", r"\b(?:page|file|document)\b[^.!?]{0,40}\b(?:does not|doesn.t) exist\b", r"\bcan.t be reached\b", r"\bcan.t (?:find|reach) (?:that|this|the) (?:page|site)\b",
    r"\bsomething (?:went wrong|failed)\b", r"\boops\b!?", r"\ban? (?:unexpected |internal |application )?error (?:has )?occurred\b", r"\b(?:application|fatal|internal|server|database|critical) error\b", r"\berror interno\b",
    r"\btraceback \(most recent call last\)(?:[^.!?]|\.(?=\w)){0,200}", r"\b(?:cannot|could not) connect to\b", r"\berror establishing\b", r"\bconnection (?:reset|refused|timed out|failed)\b", r"\b(?:gateway|server|host) (?:unreachable|busy)\b", r"\bserver (?:is )?(?:busy|overloaded|down)\b",
    r"\bunable to (?:load|open|display|connect|process)\b", r"\b(?:request|connection) (?:has )?timed out\b", r"\btook too long to respond\b", r"\binvalid (?:token|request)\b", r"\b(?:your )?session (?:has )?(?:expired|timed out)\b", r"\bplease (?:log ?in|sign in) again\b", r"\bincident (?:number|id)\b", r"\b(?:reference|ray|request) id\b",
    r"\b(?:access|permission) denied\b", r"\bthere is no (?:document|page|file)\b", r"\bdo(?:n.t| not) have permission\b", r"\bnot exist on this server\b", r"\b(?:link you followed|may have been moved|address for typing errors)\b", r"\b(?:upstream server|server side)\b", r"\bplease (?:try again|retry)\b", r"\btry again later\b", r"\bcontact the (?:site )?(?:administrator|owner|webmaster)\b", r"\b(?:scheduled|undergoing) maintenance\b", r"\b(?:will|.ll) be back (?:shortly|soon)\b", r"\b(?:go )?back to the (?:start|home) ?page\b", r"\btemporarily unavailable\b",
    r"\b(?:es ist ein|ein) (?:interner |unerwarteter )?fehler (?:ist )?aufgetreten\b", r"\bzugriff verweigert\b", r"\b(?:seite|datei|dokument)\b[^.!?]{0,40}\bnicht gefunden\b", r"\bserver konnte die anfrage\b", r"\bbitte versuchen sie es\b", r"\bmelden sie sich erneut an\b", r"\bsitzung ist abgelaufen\b", r"\bzur startseite\b", r"\b(?:dienst|server|seite) (?:ist )?(?:derzeit |momentan |vorübergehend )?nicht (?:verfügbar|erreichbar)\b", r"\binterner serverfehler\b", r"\bwartungsarbeiten\b", r"\bzeitüberschreitung\b", r"\b(?:datei|seite) /?\S{0,200} ?existiert nicht\b", r"\bfehlernummer\b", r"\bkeine berechtigung\b",
    r"\berreur (?:interne|est survenue|inattendue)\b", r"\berreur \d{1,40}\b", r"\bune erreur (?:est survenue|s.est produite)\b", r"\baccès (?:refusé|interdit)\b", r"\b(?:page|fichier|document) (?:est )?(?:introuvable|non trouvée?)\b", r"\bserveur n.a pas pu\b", r"\bveuillez (?:réessayer|vous reconnecter)\b", r"\bsession a expiré\b", r"\bretour à l.accueil\b", r"\bservice (?:momentanément |temporairement )?indisponible\b", r"\ben maintenance\b", r"\bdélai d.attente\b", r"\bn.existe pas sur ce serveur\b", r"\bnuméro d.incident\b", r"\bn.avez pas (?:le droit|l.autorisation)\b",
    r"\bse ha producido un error\b", r"\bacceso denegado\b", r"\bpágina (?:no encontrada|no existe)\b", r"\bservidor no pudo\b", r"\binténtelo de nuevo\b", r"\bsesión ha caducado\b", r"\bvuelva a iniciar sesión\b", r"\bvolver al inicio\b", r"\bservicio no disponible\b", r"\berror (?:interno )?del servidor\b", r"\ben mantenimiento\b", r"\btiempo de espera\b", r"\bno existe en este servidor\b", r"\b(?:número|código) de (?:incidente|incidencia)\b", r"\bno tiene permiso\b",
)
#: Beginnings of the words such pages are made of. A sentence with a phrase of the lists above is evidence if its words, but
#: for function words, are mostly of these or of the phrase; a report about an error names things that no notice has.
_NOTICE_STEMS = tuple(
    "page file document resource url link address site website web server service host gateway proxy browser connect network database application app request session login log sign password token account access permi error fault fail wrong invalid unexpected internal fatal found find missing exist available unavailable denied forbid refus expire clos timed time maintenance temporar current moment later again please sorry oops try tries retry reload refresh return go going back home start check spell typ contact administrator webmaster owner support incident code number reference status message detail moved move delet remov broken follow click continu open display load view show see use run work content enabl disabl activat allow turn switch block requir need javascript java script js cookie setting version modern security verif test noscript portal something someone dropped drop old new one first must cannot can could may might will would does do did has right here soon shortly side back inside out down off long took respond reach busy overload establish process generat reset unreach many menu search home help imprint report "
    "text title head summary descript paragraph caption copy body insert enter add writ put replac overwrit dummy sample filler example placeholder entry publish layout purpose goes come box real final later instead only "
    "seite datei dokument dienst verbindung anfrage angefordert sitzung anmeld meld zugriff berechtig fehler unerwartet intern gefunden existiert verfügbar erreichbar verweigert abgelaufen wartung derzeit moment vorübergehend später erneut bitte versuch lad gelad zurück startseite prüf kontakt verwalt vorfall nummer verschoben gelöscht öffn anzeig aktivier deaktivier erlaub einschalt blockier erforder benötig brauch unterstütz skript funktion einstellung zeitüberschreitung darstell dargestellt darzustell anzuzeig menü suche impressum hilfe sicherheit bericht konnte können kann muss müssen inhalt überschrift titel eingeb einfüg ersetz überschreib platzhalter blindtext beispiel folgt steht hier bald darf diese dieser dieses keine ohne nutz benutz verwend "
    "fichier lien adresse serveur navigateur connexion requête demand ouvrir accès autoris refus interdit erreur interne inattendu introuvable trouv indisponible disponible expir momentané temporaire réessay veuillez tard retour accueil vérifi numéro déplacé supprimé affich charg activ désactiv bloqu nécessair nécessit requis exig fonctionn texte titre contenu résumé saisi insér ajout remplac exemple faux ici venir mise maquette afin continuer doit doivent peut pouvoir pas droit produit survenu reconnecte menu recherch aide rapport mentions "
    "página fichero archivo enlace dirección servidor servicio navegador conexión solicitud solicit sesión acceso permiso error interno inesperado encontrad disponible denegad caducad mantenimiento momento inténtel intent nuevo tarde volver vuelva inicio inicie iniciar comprueb contacte administrador incident incidencia número código movid borrad eliminad abrir mostrar muestr ver cargar activ habilit desactiv permit bloque necesit requier necesari funcion texto título contenido resumen escrib introduzc insert sustitu ejemplo relleno prueba aquí próximament maqueta debe deben puede pudo producid existe espera sitio favor menú buscar entrar ayuda informe".split()
)
#: Further small words that say nothing about a sentence's subject.
_SMALL = frozenset("there here what who any some may me my his her i us if into over under about because while se me te lo tiene tienen hay que este esta estos estas si sí ya muy um man kann dann wenn dieser diese dieses ihre ihren ihrem ihr hat haben ne pas votre vos notre cette cet ou où si afin ont avez".split())
#: Share of a sentence's words from which the sentence as a whole is a notice; beside a phrase one other word is none too many.
NOTICE_SHARE = 0.67


def _literals(form: str) -> list[str]:
    """Runs of letters that every match of the pattern holds (those outside of groups and optional parts)."""
    flat, depth = "", 0
    for piece in re.findall(r"\\.|\[(?:\\.|[^\]])*\]|\((?:\?[:!=]|\?<[!=])?|\)(?:[?*]|\{\d*,?\d*\})?|.(?:[?*]|\{\d*,?\d*\})?", form):
        depth += piece.startswith("(") - piece.startswith(")")
        flat += piece if not depth and len(piece) == 1 and (piece.isalpha() or piece == "|") else "\n"
    return [] if "|" in flat else flat.split("\n")


def _needed(form: str) -> tuple[str, ...]:
    """Literals of which every match of the pattern holds at least one: its longest own run of letters, else one for each
    branch of its first plain group. An empty string means that nothing is known."""
    own = max(_literals(form), key=len, default="")
    if len(own) >= 3:
        return (own.casefold(),)
    group = re.search(r"\(\?:((?:[^()\\]|\\.)*)\)(?![?*])", form)
    branches = [max(_literals(x), key=len, default="") for x in group[1].split("|")] if group else [""]
    return tuple(sorted({x.casefold() for x in branches})) if all(len(x) >= 2 for x in branches) else ("",)


#: (kind, needed literals, pattern); a blank in a pattern stands for any white space.
_KINDS = [(kind, _needed(x), re.compile(x.replace(" ", r"\s").replace(r"\s*", r"\s?"), re.I | re.M)) for kind, forms in ((FILLER, _FILLER), (SCRIPT, _NOTICE), (ERROR, _ERROR)) for x in forms]


#: The longest match of each pattern; white space runs are one character in flattened text.
_WIDTH = [re._parser.parse(form.pattern).getwidth()[1] + 2 for _, _, form in _KINDS]


def _automaton() -> ahocorasick.Automaton:
    """All needed literals at once; each leads to the numbers of its patterns."""
    users: dict[str, list[int]] = {}
    for i, (_, needed, _) in enumerate(_KINDS):
        for x in needed:
            users.setdefault(x, []).append(i)
    own = ahocorasick.Automaton()
    for x, at in users.items():
        own.add_word(x, at)
    own.make_automaton()
    return own


if max(_WIDTH) > 1000:
    raise ValueError("a phrase pattern without a bound")
_LITERALS = _automaton()
_STRUCTURE = re.compile(rf"<{_TAGS}>|<!doctype[^<>]*>", re.I)
#: Paths, addresses and codes name what a page could not show; they are no words of its sentence.
_NAMES = re.compile(r"(?<!\w)(?:https?:)?/{1,2}[\w.:/?=&%+-]+|\S+@\S+|\b\w*\d\w*\b")
_QUOTES = re.compile(r"`[^`\n]*`|\"[^\"\n]*\"|“[^”\n]*”|„[^“”\n]*[“”]|«[^»\n]*»|‘[^’\n]*’")
#: Where evidence begins and ends: line ends, separators of page furniture, ends of sentences; the last do not end a line.
_CUT = re.compile(r"\s*\n\s*|\s[-–—|>·]\s|(?<=[.!?…])\s+")
_HARD = re.compile(r"\s*\n\s*|\s[-–—|>·]\s")
_INVISIBLE = re.compile("[\u00ad\u200b\u200c\u200d\u2060\ufeff]")
#: Every white space character as a blank or a line end.
_WHITE = {c: "\n" if chr(c) in "\n\r\u2028\u2029\x0b\x0c\x1c\x1d\x1e\x85" else " " for c in range(0x3001) if chr(c).isspace()}
_ODD = re.compile(r"[^\S \n]")
_BREAKS, _BLANKS = re.compile(r" *\n[ \n]*"), re.compile(r" {2,}")
_WORD = re.compile(r"[^\W\d_]+")
_DIGITS = re.compile(r"\d+")
_BORDER = " \t\n-–—|>*#+•:."


def _spaced(text: str) -> str:
    """Without invisible characters; every white space run is one blank or one line end."""
    if not text.isascii():
        text = _INVISIBLE.sub("", text)
    if _ODD.search(text):
        text = text.translate(_WHITE)
    if "\n\n" in text or " \n" in text or "\n " in text:
        text = _BREAKS.sub("\n", text)
    return (_BLANKS.sub(" ", text) if "  " in text else text).strip()


def _mash(word: str) -> bool:
    """A meaningless word: a known one, one letter again and again, or a run along a keyboard row in either direction."""
    return word in MASH or (len(word) >= 3 and (len(set(word)) == 1 or any(word in row or word[::-1] in row for row in _ROWS)))


def dummy(sentence: str, near: bool = False) -> bool:
    """Dummy Latin, keyboard filler or one word repeated: nearly all words are known ones or, with hardly a function word of
    a living language, have the form of Latin words. near: other sentences of the text are dummy text, so length does not matter."""
    words = _WORD.findall(sentence.casefold())
    if len(words) < 2:
        return False
    if sum(map(_mash, words)) >= 0.7 * len(words) or (len(words) >= 3 and len(set(words)) == 1):
        return True
    sure = not LATIN_SURE.isdisjoint(words)
    if sure and sum(w in LATIN for w in words) >= 0.7 * len(words):
        return True
    living = 0 if LIVING.isdisjoint(words) else sum(w in LIVING for w in words)
    if sure and living > 0.1 * len(words):
        return False
    if near and not living:
        sure = True
    if not sure and (living or len(words) < LATIN_WORDS or _DIGITS.search(sentence) or sum(1 for w in words if w in LATIN or _LATIN_SURE_END.search(w)) < 2):
        return False
    latin = sum(1.0 if w in LATIN or _LATIN_END.search(w) else 0.5 if _WEAK_END.search(w) else 0.0 for w in words)
    return latin >= 0.6 * len(words)


def _plain(text: str) -> str:
    """NFKC form with character references resolved."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return html.unescape(text) if "&" in text else text


def flattened(text: str) -> str:
    """NFKC form without invisible characters and markup; every white space run is one blank or one line end."""
    text = _plain(text)
    return _spaced(_STRUCTURE.sub("\n", text) if "<" in text else text)


def phrases(flat: str, low: str) -> list[tuple[int, int, str]]:
    """Stretches of flattened text that match a phrase of the lists; low: the text in lower case, of the same length.

    A pattern is tried only around its literals, as far as its longest match can reach, so that nothing is missed.
    """
    around: dict[int, list[list[int]]] = {}
    for end, at in _LITERALS.iter(low):
        for i in at:
            spans, a, b = around.setdefault(i, []), max(0, end - _WIDTH[i]), end + _WIDTH[i]
            if spans and a <= spans[-1][1]:
                spans[-1][1] = b
            else:
                spans.append([a, b])
    if not around:
        return []
    return sorted((*m.span(), _KINDS[i][0]) for i, spans in around.items() for a, b in spans for m in _KINDS[i][2].finditer(flat, a, b))


def _of_notice(line: str, own: list[tuple[int, int]]) -> bool:
    """Whether a line with phrases (own: their places in it) is a notice as a whole, and not a sentence about something."""
    if all(any(q.start() < a and b < q.end() and (q.start() > 2 or q.end() < len(line) - 2) for q in _QUOTES.finditer(line)) for a, b in own):
        return False  # every phrase is quoted
    rest, at = [], 0
    for a, b in own:
        rest.append(line[at:a])
        at = max(at, b)
    rest.append(line[at:])
    other = [w for w in _WORD.findall(_NAMES.sub(" ", " ".join(rest)).casefold()) if len(w) > 1 and w not in LIVING and w not in _SMALL]
    named = sum(len(w) > 1 for w in _WORD.findall(" ".join(line[a:b] for a, b in own)))
    foreign = sum(not w.startswith(_NOTICE_STEMS) for w in other)
    return foreign <= (1 - NOTICE_SHARE) * (named + len(other)) or (foreign == 1 and len(other) <= named + 1)


def _looked_at(flat: str) -> tuple[list[tuple[int, int, str]], bool]:
    """Phrases of a flattened text, and whether it may hold dummy text at all."""
    low = flat.lower()
    if len(low) != len(flat):  # letters whose lower case is longer
        low = "".join(c if len(c.lower()) > 1 else c.lower() for c in flat)
    words = low.split()
    living = sum(map(LIVING.__contains__, words))
    return phrases(flat, low), living <= LIVING_SHARE * len(words) or not LATIN_SURE.isdisjoint(words) or not MASH.isdisjoint(words)


def segments(flat: str, looked_at: tuple[list[tuple[int, int, str]], bool] | None = None) -> list[tuple[int, int, str | None]]:
    """Sentences of flattened text as (start, end, kind of evidence or None), whole text. A line break inside a phrase is none."""
    found, perhaps_dummy = looked_at or _looked_at(flat)
    inside = [(a, b) for a, b, _ in found]
    edges, k, reach = [0], 0, -1
    for m in _CUT.finditer(flat):
        while k < len(inside) and inside[k][0] < m.end():
            reach = max(reach, inside[k][1])
            k += 1
        if reach <= m.start() + 1:
            edges += [m.start(), m.end()]
    edges.append(len(flat))
    out: list[tuple[int, int, str | None]] = []
    k = 0
    for a, b in zip(edges[::2], edges[1::2]):
        own, kinds = [], []
        while k < len(found) and found[k][0] < b:
            own.append((found[k][0] - a, min(found[k][1], b) - a))
            kinds.append(found[k][2])
            k += 1
        if a < b:
            out.append((a, b, kinds[0] if own and _of_notice(flat[a:b], own) else None))
    if perhaps_dummy:
        for near in (False, True):
            if near and all(kind != FILLER for _, _, kind in out):
                break
            out = [(a, b, FILLER if kind is None and dummy(flat[a:b], near) else kind) for a, b, kind in out]
    return out


def line_key(piece: str) -> str:
    """Normal form of a line of flattened text: lower case, digits as 0, no outer punctuation."""
    return " ".join(_DIGITS.sub("0", piece.casefold()).split()).strip(_BORDER)


#: A line: hash of its normal form, its length, what it is evidence of (0 for nothing).
_CODES = {None: 0, PLACEHOLDER: 1, FILLER: 2, ERROR: 3, SCRIPT: 4}


def lines(text: str) -> list[tuple[str, int, int]]:
    """(normal form, length, code of evidence) of every line; a placeholder marks the line it stands in."""
    plain = _plain(text)
    spaced = _spaced(plain)
    flat = _spaced(_STRUCTURE.sub("\n", plain)) if "<" in plain else spaced
    marks = forms(spaced)
    out, from_ = [], 0
    spots = []
    for m in marks:  # places of the forms in the flattened text, in order
        at = flat.find(m, from_)
        spots.append(at)
        from_ = max(from_, at)
    looked_at = _looked_at(flat)
    if not marks and not looked_at[0] and not looked_at[1]:
        keys = [line_key(x) for x in _HARD.split(flat)]
        return [(x, len(x), 0) for x in keys if x]
    start, end, k = 0, -1, 0
    for a, b, kind in [*segments(flat, looked_at), (len(flat), len(flat), PLACEHOLDER)]:
        held = False
        while k < len(spots) and spots[k] < b:
            held, k = held or spots[k] >= a, k + 1
        bare = kind is None and not held
        # Sentences of one line stay together, unless one of them is evidence.
        if bare and end >= 0 and not _HARD.fullmatch(flat[end:a]):
            end = b
            continue
        if end >= 0:
            key = line_key(flat[start:end])
            if key:
                out.append((key, len(key), 0))
            end = -1
        if bare:
            start, end = a, b
        elif a < b:
            key = line_key(flat[a:b])
            out.append((key, max(len(key), 1), _CODES[PLACEHOLDER if held else kind]))
    if marks and not any(code == 1 for _, _, code in out):
        out.append(("", 1, 1))  # a form that markup removal took along
    return out


def scan(documents: DataFrame) -> DataFrame:
    """(doc_id, host, text_hash, suspect, h, n, e arrays) of every document, whole texts: its lines with length and evidence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signed = lambda s: int.from_bytes(xxhash.xxh64_digest(s), "big", signed=True)
        for batch in batches:
            hashes, suspect, offsets, h, n, e = [], [], [0], [], [], []
            for text in batch.column("text").to_pylist():
                text = text or ""
                own = lines(text)
                hashes.append(signed(text.encode()))
                suspect.append(any(code for _, _, code in own))
                h += [signed(key.encode()) for key, _, _ in own]
                n += [size for _, size, _ in own]
                e += [code for _, _, code in own]
                offsets.append(len(h))
            at = pa.array(offsets, pa.int32())
            arrays = [pa.ListArray.from_arrays(at, pa.array(x, t)) for x, t in ((h, pa.int64()), (n, pa.int32()), (e, pa.int8()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("host"), pa.array(hashes, pa.int64()), pa.array(suspect, pa.bool_()), *arrays], names=["doc_id", "host", "text_hash", "suspect", "h", "n", "e"])

    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("host").cast("string").alias("host"), F.col("text").cast("string").alias("text"))
    return spread(rows).mapInArrow(run, "doc_id bigint, host string, text_hash bigint, suspect boolean, h array<bigint>, n array<int>, e array<tinyint>")


def find_residue(documents: DataFrame) -> DataFrame:
    """(doc_id, kind, share) of the records that are no content: kind placeholder, filler, error or script.

    documents: doc_id, host, text. Lines are counted by host over different texts. A line that recurs is boilerplate and is
    subtracted, whatever it says, if it stands beside content: a line without evidence always (menus, titles, footers), a line
    with evidence if at least BESIDE_CONTENT of its texts have OWN_CHARS of lines that neither recur nor are evidence (a footer
    'please try again later'; not the message of the error pages of a host). The rest is the residual. share: part of the
    residual that is evidence; a record is a case from LEAST_SHARE on, or if its residual has a placeholder (share 1).

    A NULL or empty text is no case (there is no evidence in it). A NULL host is a host of its own. Repeated texts count once
    for the recurrence of a line, and each of their rows is judged. Empty tables give no rows.
    """
    seen = cut(scan(documents))
    host = F.coalesce(F.concat(F.lit("h"), "host"), F.lit(""))  # a plain equality key, NULL included
    seen = seen.withColumn("host", host)
    # Different lines of different texts; only lines that a suspect text has need a count.
    single = lambda df: df.select("host", "text_hash", F.explode(F.arrays_zip("h", "n", "e")).alias("l")).select("host", "text_hash", "l.h", "l.n", "l.e")
    own = single(seen.where("suspect").select("host", "text_hash", "h", "n", "e").dropDuplicates(["host", "text_hash"])).groupBy("host", "text_hash", "h").agg(F.sum("n").alias("n"), F.max("e").alias("e"))
    all_lines = seen.select("host", "text_hash", F.explode("h").alias("h"))
    counted = all_lines.join(own.select("host", "h").distinct(), ["host", "h"], "left_semi").groupBy("host", "h", "text_hash").agg(F.lit(1).alias("one")).groupBy("host", "h").agg(F.count("*").alias("texts"))
    totals = seen.groupBy("host", "text_hash").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count("*").alias("all_texts"))
    recurrent = counted.where(F.col("texts") >= RECURRENT_TEXTS).join(totals, "host").where(F.col("texts") >= RECURRENT_SHARE * F.col("all_texts")).select("host", "h", F.lit(True).alias("recurs"))
    marked = own.join(recurrent, ["host", "h"], "left").withColumn("recurs", F.coalesce("recurs", F.lit(False)))
    marked = cut(marked)
    # Recurrent lines with evidence: do their texts have content of their own?
    carried = marked.groupBy("host", "text_hash").agg(F.sum(F.when(~F.col("recurs") & (F.col("e") == 0), F.col("n")).otherwise(0)).alias("own"))
    beside = marked.where(F.col("recurs") & (F.col("e") > 0)).join(carried, ["host", "text_hash"]).groupBy("host", "h").agg(F.avg((F.col("own") >= OWN_CHARS).cast("double")).alias("part"))
    footers = beside.where(F.col("part") >= BESIDE_CONTENT).select("host", "h")
    residual = marked.where(~F.col("recurs") | (F.col("e") > 0)).join(footers, ["host", "h"], "left_anti")
    amount = lambda code: F.sum(F.when(F.col("e") == code, F.col("n")).otherwise(0))
    sums = residual.groupBy("host", "text_hash").agg(F.max((F.col("e") == 1).cast("int")).alias("open"), *[amount(_CODES[k]).alias(k) for k in (FILLER, ERROR, SCRIPT)], F.sum("n").alias("held"))
    evidence = F.col(FILLER) + F.col(ERROR) + F.col(SCRIPT)
    most = F.greatest(*[F.struct(F.col(k).alias("a"), F.lit(k).alias("k")) for k in (FILLER, ERROR, SCRIPT)])["k"]
    share = F.when(F.col("open") == 1, F.lit(1.0)).otherwise(evidence / F.col("held"))
    judged = sums.select("host", "text_hash", F.when(F.col("open") == 1, F.lit(PLACEHOLDER)).otherwise(most).alias("kind"), share.alias("share")).where((F.col("open") == 1) | ((evidence > 0) & (F.col("share") >= LEAST_SHARE)))
    return seen.where("suspect").select("host", "text_hash", "doc_id").join(judged, ["host", "text_hash"]).select("doc_id", "kind", "share")
