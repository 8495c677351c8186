"""Template residue, filler text, error pages and scripts-required notices.

Texts are cut into units (sentences of lines) after everything that is quoted or shown as code is taken out. All units
of all texts are aligned over the corpus by their words:

* A slot is induced where aligned units differ: units with the same words around a place that holds a marker (a
  variable's name, a default, a blank) in one and something else in another, or the same marker in several documents.
  Slots that still hold a name, a default or nothing are unfilled.
* A page template is a unit that several documents repeat. Repeated units that also read like an error, a filler or a
  scripts-required notice are residue, and so are units that occur nearly only beside such units, in different places,
  and texts of page furniture and nothing but repeated units.

The fixed values below are templates that are known from elsewhere: each counts as one record more that a unit is
aligned with, so a document that alone holds one is found too. `flag_residue` says of each record whether the corpus
gave the proof ('aligned') or only a fixed value did ('listed').
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from re import _parser

import ahocorasick
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import Written

# --- fixed values: shapes of slots

_NAME = r"[A-Za-z][A-Za-z0-9]*(?:[ _.\-][A-Za-z0-9]+)*"
#: Only templates use these.
SURE = [
    r"\{\{[^{}\n]*\}\}",
    r"\{%-?[^%\n]+%\}",
    r"<%[^%\n]+%>",
    r"\$\{[a-z_][\w.]*\}",
    r"#\{[A-Za-z_][\w.]*\}",
    r"%\([A-Za-z_]\w*\)[sdf]",
    r"@@\w+@@",
    rf"\[\[{_NAME}\]\]",
    rf"<<{_NAME}>>",
    rf"&lt;{_NAME}&gt;",
    r"\[(?i:insert|enter|add|your|fill in)\b[^\]\n]+\]",
    r"<(?i:insert|enter|your)\b[^>\n]+>",
]
#: Prose, mathematics or code may use these too: a slot where several documents have it, or aligned units differ.
MAYBE = [
    r"(?<![\\\w}$^])\{[A-Za-z][A-Za-z0-9]+(?:_[A-Za-z0-9]+)*\}",
    r"<[A-Z][A-Z0-9]*(?:[_ \-][A-Z0-9]+)*>",
    r"\[[A-Z]{2,}(?:[_ \-][A-Z]{2,})*\]",
    r"%[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*%",
    r"(?<!\w)__[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*__(?!\w)",
    r"\((?i:your) [a-z ]+\)",
    r"\bX{4,}\b",
    r"(?<!_)_{4,}(?!_)",
]
#: Names that prose often uses: a slot only where aligned units differ.
RARELY = [
    r"(?<![\w$])\$[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*\b",
    r"\$\{[A-Z_][\w.]*\}",
    r"(?<![\w.$])[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+\b(?![.(])",
    r"(?<![\\\w}$^])\{[A-Za-z]\}",
    r"\[[A-Z][a-z]+(?: [A-Z]?[a-z]+)*\](?!\()",
]
#: Defaults: unfilled only in a slot that template-only markers hold in other documents.
DEFAULT = [r"(?<![\w/])(?:N/A|n/a|TBD|TODO|FIXME|null|NULL|undefined|NaN|None|\[object Object\])(?![\w/])"]
_SLOT = regex.compile("|".join(f"({'|'.join(x)})" for x in (SURE, MAYBE, RARELY, DEFAULT)))

# --- fixed values: what shows a text as a subject

_SHOWN = [
    regex.compile(r"(?s)```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)"),
    regex.compile(r"(?s)<(pre|code)\b[^>]*>.*?</\1>"),
    regex.compile(r"(?<!`)(`+)(?!`)[^\n]+?(?<!`)\1(?!`)"),
    regex.compile(r'(?s)(?<=[\s(\[:,])"\s*\{.*?\}"(?=[\s.,;:)\]]|$)'),
    regex.compile(r'(?s)(?<=[\s(\[:,])"\s*<.*?>"(?=[\s.,;:)\]]|$)'),
    regex.compile(r'(?s)(?<=[\s(\[,])"(?=\S)[^"]+"(?=[\s.,;:)\]]|$)'),
    regex.compile(r"(?s)“[^”]+”|„[^“”]+[“”]|«[^»]+»|「[^」]+」|『[^』]+』|‘[^’\n]+’(?!\w)"),
    regex.compile(r"(?s)\$\$.*?\$\$|\\\[.*?\\\]|\\\(.*?\\\)"),
]
_TAG = regex.compile(r"(?i)</?(?:html|head|body|title|h[1-6]|p|div|span|center|noscript|main|section|br|hr)\b[^>]*>")
_UNIT = regex.compile(r"\n+|(?<=[.!?])\s+|(?<=[.!?][\"'”)])\s+|(?<=[。！？])\s*")
_TRIM = " \t\r\n .:;,-–—!…*#>|·。！"

# --- fixed values: kinds of pages without content

_STATUS = (
    r"(?:http |error |status |code )?(?:bad request|unauthori[sz]ed|payment required|forbidden|not found|method not allowed|request timeout|gone|too many requests|"
    r"internal server error|not implemented|bad gateway|service (?:temporarily )?unavailable|gateway time-?out)"
)
_HEAD = (
    rf"(?:(?:http|error|erreur|fehler|erro|errore|エラー|错误|status)[ :/]*[45]\d\d(?: {_STATUS})?|[45]\d\d {_STATUS}|[45]\d\d错误|"
    r"not found|page not found|access denied|permission denied|session expired|server error|internal server error|something went wrong|request failed|oops|connection timed out|service indisponible|dienst nicht verfügbar|servicio no disponible|serviço indisponível|temporarily unavailable|"
    r"application error: an? (?:client|server)-side exception has occurred|service unavailable|"
    r"page introuvable|accès refusé|erreur du serveur|página no encontrada|acceso denegado|error del servidor|seite nicht gefunden|zugriff verweigert|serverfehler|"
    r"página não encontrada|acesso negado|erro (?:do|no) servidor|ページが見つかりません|アクセスが拒否されました|サーバーエラー|页面不存在|页面未找到|服务器错误|拒绝访问|访问被拒绝)"
)
_BODY = (
    r"(?:the (?:page|document|resource|file|url) you (?:asked for|requested|are looking for) (?:does not exist|could not be found|was not found|has been removed)(?: on this server)?|"
    r"the requested (?:[a-z]+ )?(?:page|url|resource|document) (?:could not be|was not) found(?: on this server)?|"
    r"this (?:resource|page|document) is no longer available|you do not have permission to (?:view|access) this (?:resource|page|document)|you have sent too many requests|"
    r"the (?:upstream|origin|gateway|server)(?: service| server)? (?:did not answer in time|returned an invalid response|timed out)|"
    r"the server (?:met|encountered) an unexpected condition and could not complete the request|the link may be broken,? or the page may have been (?:moved|removed)|"
    r"verify (?:that )?you are (?:a )?human(?: by completing the check below)?|we(?:'|’)?re down for maintenance|we could not load this (?:document|page)|an unknown (?:problem|error) occurred|"
    r"(?:please )?sign in again to continue|your session has expired|"
    r"beim laden ist ein fehler aufgetreten|das angeforderte dokument (?:existiert nicht mehr|wurde nicht gefunden)|une erreur est survenue lors du chargement|"
    r"le document demandé n[’']existe plus|se produjo un (?:problema|error) al cargar el contenido|el documento solicitado ya no existe|"
    r"ocorreu um (?:problema|erro) ao carregar o conteúdo|o documento solicitado não existe mais|"
    r"urlをご確認ください|しばらくしてからもう一度お試しください|请检查地址后重试|请稍后再试)"
)
_ERROR = regex.compile(rf"(?i)^(?:{_HEAD}(?:[\s.:–—-]+{_BODY})?|{_BODY})(?:[\s.:–—-]+(?:digest|request id|retry after|host|path)\b.*)?$")
_ERROR_JSON = regex.compile(r'(?im)^\s*(?:<[^>\n]*>)*\{\s*"(?:error"\s*:\s*[\{"]|status"\s*:\s*(?:"(?:error|fail|failed|failure)"|[45]\d\d)|message"\s*:\s*"(?:internal|not found|forbidden)).*\}')

_PAGE = r"(?:this|the|our|your) (?:[\w-]+ ){0,3}[\w-]+"
_SCRIPTS = regex.compile(
    rf"(?i)^(?:{_PAGE} (?:needs|requires) (?:javascript|scripts)(?: to be enabled)?|{_PAGE} relies on client-side scripts|{_PAGE} could not start because scripts are blocked|"
    rf"{_PAGE} cannot be shown while scripting is turned off|{_PAGE} (?:does not|will not|doesn't|won't) work without (?:javascript|scripts)|"
    r"(?:please )?(?:enable|activate|turn on|allow) (?:javascript|scripts)\b[^.;]{0,60}|you need to enable (?:javascript|scripts)\b[^.;]{0,40}|javascript (?:is|seems to be) (?:disabled|turned off|required)\b[^.;]{0,40}|"
    r"your browser (?:blocks scripts or does not support them|does not support (?:javascript|scripts))|we're sorry but \S+ doesn't work properly without javascript enabled[^.;]{0,40}|"
    r"bitte aktivieren sie javascript\b[^.;]{0,60}|diese seite funktioniert nur mit (?:eingeschalteten skripten|javascript)|"
    r"veuillez activer (?:javascript|les scripts)\b[^.;]{0,60}|ce site nécessite (?:l[’']exécution de scripts|javascript)|active (?:el )?javascript\b[^.;]{0,60}|habilite javascript\b[^.;]{0,60}|"
    r"esta página (?:necesita|requiere) javascript|ative o javascript\b[^.;]{0,60}|esta página (?:precisa de|requer) javascript|"
    r"[^。]{0,20}javascript(?:を|が)有効[^。]{0,20}|[^。]{0,8}请(?:启用|开启)(?:脚本|javascript)[^。]{0,12}|[^。]{0,8}需要(?:启用)?(?:脚本|javascript)[^。]{0,12})$"
)

_FILLER = regex.compile(
    r"(?i)^(?:description coming soon|(?:content|text) coming soon|coming soon|(?:sample text\s*){2,}|your (?:content|text) goes here|type your text here|(?:click|tap) to (?:add|edit) text|"
    r"(?:enter|insert|add|write) (?:your )?(?:text|content|description) here|(?:this )?page (?:is )?intentionally left blank\b.{0,60}|placeholder text|this is (?:a )?placeholder\b.{0,40}|"
    r"hier steht später (?:die|der|das) \w+|(?:dies|das) ist (?:nur )?ein blindtext|platzhaltertext|(?:este|esto) es un texto de relleno|texto de relleno|escriba aquí (?:la|el|su) \w+|"
    r"texte à compléter|insérez ici (?:la|le|votre) \w+.{0,30}|texte de remplissage|(?:este é um )?texto de (?:preenchimento|exemplo)|(?:escreva|insira) aqui (?:a|o|sua|seu) \w+.{0,30}|"
    r"ここに\w{1,8}を入力してください|ここにテキストを入力|(?:请)?在此(?:处)?(?:输入|填写)\w{1,10}|此处(?:填写|输入)\w{1,10}|这是占位文本|占位文字?|tbd|to be (?:written|completed|added)|n/?t?bc)$"
)
_INSTEAD = regex.compile(
    r"(?i)^(?:replace this (?:paragraph|text|section|sentence|line)\b.{0,80}|(?:add|insert|put|write|type|enter|paste) (?:\w+ ){0,6}(?:here|below)|lorem ipsum.{0,40}|"
    r"(?:ersetzen sie diesen (?:absatz|text)|remplacez ce (?:paragraphe|texte)|reemplace este (?:párrafo|texto)|substitua este (?:parágrafo|texto))\b.{0,80})$"
)
#: Keys struck at random, and words that stand for any word.
_MASH = frozenset("asdf asdfasdf qwer qwerty qwertz sdfg dfgh hjkl jkl zxcv test tests testing foo bar baz qux blah bla xxx yyy zzz abc abcd dummy".split())
#: The words error pages are made of; a unit that holds no other word than these and small ones is one.
_ERROR_WORDS = frozenset(
    "error errors http failed failure fail request requested requests page pages document resource resources file url link address server service gateway session sessions access "
    "permission permissions unavailable available expired expire denied forbidden unauthorized timeout timed connection lost maintenance down offline overloaded busy blocked banned refused "
    "invalid unexpected internal unknown problem wrong went something oops sorry retry again later reload refresh login log sign signed administrator support captcha robot human verify "
    "verification exist exists existed found missing removed moved broken loaded load complete completed limit rate exceeded quota try trying please back soon shortly moment minutes "
    "erreur requête page document ressource fichier lien adresse serveur service passerelle session accès autorisation indisponible disponible expiré expirée refusé refusée interdit délai "
    "connexion maintenance invalide inattendue inconnu inconnue problème réessayez réessayer reconnectez reconnecter plus tard introuvable trouvée trouvé existe veuillez demandé demandée survenue "
    "fehler anfrage seite dokument ressource datei server dienst sitzung zugriff zugang berechtigung verfügbar nicht abgelaufen verweigert verboten verbindung wartung ungültig unerwarteter "
    "unbekannter problem versuchen erneut später anmelden gefunden existiert angeforderte angeforderten bitte aufgetreten "
    "solicitud página documento recurso archivo enlace dirección servidor servicio sesión acceso permiso permisos disponible caducado caducada expirado expirada denegado denegada prohibido "
    "conexión mantenimiento inválida inesperado desconocido problema intente nuevo inicie encontrada encontrado existe solicitado solicitada ocurrió producido produjo ha "
    "solicitação arquivo serviço sessão permissão indisponível expirou negado negada proibido conexão manutenção inválido erro tente novamente ocorreu solicitado faça".split()
)
#: Of these a unit needs one, so that a line of small words is no page.
_ERROR_KEYS = frozenset(
    "error failed failure unavailable expired denied forbidden unauthorized timeout maintenance indisponible expiré expirée refusé introuvable abgelaufen verweigert wartung fehler caducado caducada "
    "expirado expirada denegado mantenimiento indisponível expirou negado manutenção erro erreur verfügbar disponible existe existiert exist exists found reconnectez oops wrong".split()
)
_SMALL = frozenset(
    "t re ve ll a an the this that is are was were be been has have had not no you your we our us it its to of on in at for by or and may can could do does did with if in the from more "
    "le la les un une de des du ce cette votre vous nous est a été n ne pas plus se sur dans pour l d s c qu "
    "der die das den dem ein eine dieser diese dieses ist sind war wurde hat mehr sie ihre ihr ihren wir zu auf im in für mehr es "
    "el la los las un una de del su sus se es ya no en por para al lo le y o usted "
    "o a os as um uma do da dos das seu sua se é já não em para por e mais "
    "il lo gli di da per con su sono i un una che ha è della del al alla questo questa "
    "de het een van te op voor met uw je u dit deze er dat "
    "i din ditt er du det en et og som för på av att kan jeg deg vår den denne nå "
    "w na z do jest się ten ta to o po że "
    "в на и с по о к для это эта этот вы мы bu şu ve bir için".split()
)
_ERROR_CJK = regex.compile(r"^(?=.{2,40}$)(?:.*(?:会话|登录|服务|页面|服务器|请求|资源|权限|访问).*(?:过期|失效|不可用|不存在|失败|错误|拒绝|超时|重试|重新)|.*(?:セッション|サービス|ページ|サーバー|アクセス|リクエスト|リソース|ログイン).*(?:期限|切れ|利用でき|存在し|失敗|エラー|拒否|見つかり|もう一度|再度|やり直)).*$")
#: Page furniture: a line of links, or markup around a whole text.
_CHROME_LINE = regex.compile(r"(?i)^(?:skip to (?:main )?content|(?:[\p{L}]+(?: [\p{L}]+)?)(?:(?: [|·•] | {2,})(?:[\p{L}]+(?: [\p{L}]+)?)){2,6})$")
_CHROME_TAG = regex.compile(r"(?i)<(?:html|body|noscript)\b")
#: The words of the usual filler text.
LOREM = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation "
    "ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non "
    "proident sunt culpa qui officia deserunt mollit anim id est laborum".split()
)
#: More words that such text is often made of.
LOREM = LOREM | frozenset(
    "vestibulum vehicula quam diam faucibus nec ultricies pellentesque habitant morbi tristique senectus netus malesuada fames turpis egestas proin sagittis mauris vitae eros donec vel sapien elementum "
    "pulvinar etiam curabitur tortor condimentum lacinia quis ante ipsum primis orci luctus ultrices posuere cubilia curae vivamus suscipit tempus nullam porttitor blandit praesent sollicitudin massa nisl "
    "dictum fermentum integer feugiat scelerisque varius natoque penatibus magnis dis parturient montes nascetur ridiculus mus nunc felis arcu leo augue phasellus hendrerit maecenas pharetra convallis".split()
)
_WORD = regex.compile(r"[\p{L}\p{N}]+")
_PLAIN_WORD = re.compile(r"[a-z0-9]+")
#: A unit is filler from this many of its words, and this share, being filler words.
LOREM_WORDS, LOREM_SHARE = 4, 0.8

#: Stems of what an error page is about, of what went wrong with it, and of a scripts notice; a unit that is mostly made of them reads like one.
_ABOUT = (
    "page site server document resource file link address request session access connection service website content database browser owner administrator",
    "seite dokument ressource datei adresse anfrage sitzung zugriff verbindung dienst inhalt",
    "pagina sito documento risorsa richiesta sessione accesso connessione servizio contenuto",
    "página sitio recurso archivo enlace solicitud sesión acceso conexión servicio arquivo sessão acesso conexão serviço",
    "ressource fichier lien requête accès connexion demandé",
    "bestand verbinding verzoek sessie toegang dienst", "stron serwer plik żądani sesj dostęp połączeni", "stránk server soubor požadav relace přístup připojení", "side tjener fil forespørsel økt tilgang tilkobling tjeneste", "sivu palvelin tiedosto", "sida sidan filen begäran åtkomst anslutning",
    "страниц сайт сервер сервис документ ресурс файл запрос сесси доступ соединени", "sayfa sunucu dosya istek oturum erişim bağlantı", "페이지 서버 파일 요청 접근 연결",
)
_WRONG = (
    "error fail failed fails failure not found missing unavailable reached denied forbidden refused expired timeout invalid broken sorry oops wrong try again reload retry can't cannot couldn't unable load refresh blocked establishing checking accessing",
    "fehler nicht gefunden verfügbar verweigert abgelaufen erneut ungültig", "errore non trovata trovato disponibile negato scaduta riprova riprovare impossibile",
    "encontrada encontrado disponible denegado caducado inténtelo intente disponível negado expirou tente novamente não",
    "introuvable indisponible refusé expiré réessayez erreur", "niet gevonden beschikbaar geweigerd verlopen fout opnieuw probeer", "błąd nie znalezion niedostępn odmow wygasł spróbuj ponownie", "chyba nenalezen nedostupn odepřen vypršel zkuste znovu", "feil oppstod ikke funnet utilgjengelig nektet utløpt prøv igjen senere", "virhe löydy",
    "fel hitta inte kunde tillgänglig nekad försök igen", "ошибк не найден недоступ временно отказано истек попробуйте снова", "hata bulunamadı kullanılamıyor reddedildi tekrar deneyin", "오류 찾을 없습니다 거부 다시",
)
_SCRIPT_WORDS = (
    "javascript javascripts scripts cookies browser enable enabled disabled turn activate allow requires required need needs without please",
    "aktivieren browser einschalten benötigt bitte", "abilita attiva richiede", "activa active habilita requiere navegador", "ative habilite requer", "activez nécessite navigateur",
    "schakel inschakelen vereist", "włącz przeglądarka wymaga", "aktivera webbläsare kräver", "включите браузер требуется", "etkinleştirin tarayıcı", "활성화 브라우저",
)
#: Short ones must be the whole word.
_stems = lambda *lists: re.compile("(?:" + "|".join(sorted({re.escape(w) + (r"\b" if len(w) < 5 and w.isascii() else "") for part in lists for line in part for w in line.split()}, key=lambda w: (-len(w), w))) + ")")
_ABOUT_STEM, _WRONG_STEM, _SCRIPT_STEM = _stems(_ABOUT), _stems(_WRONG), _stems(_SCRIPT_WORDS)
#: Of its words but small ones and numbers this share must have such a stem.
STEM_SHARE = 0.75

#: A line belongs to a page template if at least this share of its occurrences stands beside proven page units.
PAGE_SHARE = 0.9
#: Or at least this share stands in texts that are furniture and repeated units only.
BARE_SHARE = 0.5
#: Words a template must have beside its slots for a unit with just these words to be one whose slots are blank.
BLANK_WORDS = 3

#: What a text must hold for the patterns of _SHOWN to find anything, in their order.
_OPENERS = [("```", "~~~"), ("<pre", "<code", "<PRE", "<CODE"), ("`",), ('"',), ('"',), ('"',), ("“", "„", "«", "「", "『", "‘"), ("$$", "\\[", "\\(")]
#: A unit without any of these holds no slot.
_SLOT_MARKS = re.compile(r"\{[{%A-Za-z]|<[<%A-Za-z]|\[[\[A-Za-z]|\$[A-Z{]|%[A-Z(]|@@|#\{|&lt;|__|XXXX|[A-Z0-9]_[A-Z0-9]|\([Yy]")
#: One without these and the other marks holds no default either.
_DEFAULT_MARKS = re.compile("N/A|n/a|TBD|TODO|FIXME|null|NULL|undefined|NaN|None")
_DEFAULT = regex.compile(f"()()()({'|'.join(DEFAULT)})")


def _required(p) -> set[str] | None:
    """Lower-case parts of which each match of a parsed pattern holds one; None if unknown."""
    found: list[set[str]] = []
    run = ""
    for op, arg in [*p, (None, None)]:
        if op is _parser.LITERAL:
            run += chr(arg).lower()
            continue
        if run:
            found.append({run})
            run = ""
        own: set[str] | None = None
        if op is _parser.SUBPATTERN:
            own = _required(arg[-1])
        elif op is _parser.BRANCH:
            each = [_required(x) for x in arg[1]]
            own = None if None in each else set().union(*each)
        elif op in (_parser.MAX_REPEAT, _parser.MIN_REPEAT) and arg[0]:
            own = _required(arg[2])
        if own is not None:
            found.append(own)
    return max(found, key=lambda x: (min(map(len, x)), -len(x)), default=None)


#: Every match of a pattern of a kind holds one of these in lower case. They are made from the patterns, so never narrower.
_KINDS = (_ERROR, _SCRIPTS, _FILLER, _INSTEAD)
_PARTS = set().union(*(_required(_parser.parse(p.pattern)) for p in _KINDS))
_CUES = ahocorasick.Automaton()
for _part in _PARTS:
    _CUES.add_word(_part, len(_part))
_CUES.make_automaton()
_cued = lambda low: next(_CUES.iter(low), None) is not None
#: Words of which a unit of word-list kinds holds one.
_WORD_CUES = _ERROR_KEYS | _MASH | LOREM
_WORDS = re.compile(r"\w+")
_CJK = re.compile(r"[぀-ヿ一-鿿]")
_SENTENCE = re.compile(r"([.!?][\"'”)]?)\s+|([。！？])\s*")
_JOINED = re.compile(r"\.?: | - | – ")
_STATUS_NUMBER = re.compile(r"\b[45]\d\d\b")
_IS_SMALL, _IS_WRONG, _IS_ABOUT, _IS_SCRIPT = 1, 2, 3, 4


class _Says(dict):
    """What each word met says; it starts anew when it grows too large, results are the same."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        tests = ((lambda w: w in _SMALL or w == "0", _IS_SMALL), (_WRONG_STEM.match, _IS_WRONG), (_ABOUT_STEM.match, _IS_ABOUT), (_SCRIPT_STEM.match, _IS_SCRIPT))
        self[word] = found = next((kind for test, kind in tests if test(word)), 0)
        return found


_SAYS = _Says()

#: What speaks for a unit: a fixed value (one record more), only its words (it must be repeated), or nothing.
KNOWN, CUED, PLAIN = 2, 1, 0


def visible(text: str, first: int = 0) -> str:
    """The text without what it shows as code, quotes or formulas; each such part leaves a mark."""
    for p, marks in list(zip(_SHOWN, _OPENERS))[first:]:
        if any(m in text for m in marks):
            text = p.sub(" ◦ ", text)
    return _TAG.sub("\n", text) if "<" in text else text


_DIGIT = re.compile(r"\d")


def _shape(low: str) -> list[str]:
    """The words of a lower-case unit; numbers and what holds digits are alike."""
    words = _WORDS.findall(low)
    return ["0" if _DIGIT.search(w) else w for w in words] if _DIGIT.search(low) else words


def _hash(*words: str) -> int:
    """A signed 64-bit hash, never 0 (which stands for none)."""
    h = xxhash.xxh3_64_intdigest(" ".join(words))
    return (h - (1 << 64) if h >> 63 else h) or 1


def page_kind(unit: str, low: str, words: list[str]) -> tuple[str, int]:
    """What kind of page a unit reads like and how sure that is: KNOWN, CUED, or ('', PLAIN)."""
    if _cued(low):
        u = unit.strip(_TRIM)
        if _ERROR.match(u):
            return "error", KNOWN
        if _SCRIPTS.match(u):
            return "scripts", KNOWN
        if _FILLER.match(u) or _INSTEAD.match(u):
            return "filler", KNOWN
    if not _WORD_CUES.isdisjoint(words):
        n = len(words)
        if n >= 3 and sum(w in _MASH for w in words) >= 0.6 * n:
            return "filler", KNOWN
        ws = _WORD.findall(low)
        told = [w for w in ws if w in _ERROR_WORDS and w not in _SMALL]
        if len(told) >= 2 and any(w in _ERROR_KEYS for w in told) and all(w in _ERROR_WORDS or w in _SMALL for w in ws):
            return "error", KNOWN
        n = sum(w in LOREM for w in ws)
        if n >= LOREM_WORDS and n >= LOREM_SHARE * len(ws):
            return "filler", KNOWN
    if not unit.isascii() and _CJK.search(unit) and _ERROR_CJK.match(unit.strip(_TRIM)):
        return "error", KNOWN
    told = [_SAYS[w] for w in words]
    # what the words alone say, but for small ones and numbers
    if _IS_WRONG in told and (_IS_ABOUT in told or told.count(_IS_WRONG) > 1 or _STATUS_NUMBER.search(low)) and told.count(_IS_WRONG) + told.count(_IS_ABOUT) >= STEM_SHARE * (len(told) - told.count(_IS_SMALL)):
        return "error", CUED
    if ("javascript" in low or "cookies" in low) and told.count(_IS_SCRIPT) >= STEM_SHARE * (len(told) - told.count(_IS_SMALL)):
        return "scripts", CUED
    return "", PLAIN


def _slots(unit: str) -> list[tuple] | None:
    """(words hash, left-anchored, right-anchored, context, marker, rank, marker text) of each slot-like place; None if there is none.

    The context of a place is up to two words on either side, up to the next place. A place without words around it is
    its own context if its marker is one that only templates use.
    """
    found = list((_SLOT if _SLOT_MARKS.search(unit) else _DEFAULT).finditer(unit))
    if not found:
        return None
    parts, at = [], 0
    for m in found:
        parts.append(_shape(unit[at : m.start()].lower()))
        at = m.end()
    parts.append(_shape(unit[at:].lower()))
    words = [w for p in parts for w in p]
    h = _hash(*words) if len(words) >= BLANK_WORDS else 0
    a, z = parts[0], parts[-1]
    one = _hash(a[0], a[1], z[-1]) if len(a) >= 2 and z else 0
    two = _hash(a[0], z[-2], z[-1]) if a and len(z) >= 2 else 0
    out = []
    # two different names in one unit are as good as a shape that prose seldom has
    two_names = len({m.group() for m in found if m.lastindex == 3 and len(m.group()) > 3}) > 1
    for i, m in enumerate(found):
        rank = 2 if two_names and m.lastindex == 3 else 4 - m.lastindex
        left, right = parts[i][-2:], parts[i + 1][:2]
        alone = not left and not right
        ctx = _hash("alone", "" if rank == 3 else m.group()) if alone else _hash(*left, "◇", *right)
        out.append((h, one, two, ctx, _hash(m.group()), rank, " ".join([*left, "◇", *right])))
    return out


def units(text: str) -> list[tuple]:
    """(slot, kind, rank, page, h, one, two, ctx, marker, said) of each unit of a text; see `aligned_units`."""
    plain = text
    for p, marks in zip(_SHOWN[:5], _OPENERS):  # a JSON error has quotes of its own, so only quotes around it take it out
        if any(m in plain for m in marks):
            plain = p.sub(" ◦ ", plain)
    out: list[tuple] = []
    if "{" in plain and _ERROR_JSON.search(plain):
        out.append((False, "error", KNOWN, False, _hash("json error"), 0, 0, 0, 0, "{json}"))
    shown = visible(plain, 5)
    lines = [u for u in shown.split("\n") if u and not u.isspace()]
    rest = [u for u in lines if not (u[0] in "Ss" or "|" in u or "·" in u or "•" in u or "  " in u) or not _CHROME_LINE.match(u.strip())]
    page = len(rest) < len(lines) or ("<" in plain and _CHROME_TAG.search(plain) is not None)
    before = 0
    for line in rest:
        for unit in _SENTENCE.sub(r"\1\2\n", line).split("\n"):
            if not unit or unit.isspace():
                continue
            found = _slots(unit) if _SLOT_MARKS.search(unit) or _DEFAULT_MARKS.search(unit) else None
            if found:
                out.extend((True, "template", rank, page, h, one, two, ctx, marker, said) for h, one, two, ctx, marker, rank, said in found)
                if any(f[5] for f in found):
                    before = found[0][0]
                    continue
            low = unit.lower()
            words = _shape(low)
            if not words:
                continue
            kind, rank = page_kind(unit, low, words)
            if rank < KNOWN and (": " in low or " - " in low or " – " in low):
                # a page's parts joined in one line: the first one tells alone, a later one if the whole is repeated
                for i, part in enumerate(_JOINED.split(unit)):
                    k, r = page_kind(part, part.lower(), _shape(part.lower()))
                    if r == KNOWN:
                        kind, rank = k, KNOWN if i == 0 else CUED
                        break
            h = _hash(*words)
            shown_part = "◦" in unit
            # a unit that shows something is none of a page's, but its words may still be aligned
            out.append((False, kind, rank, page, h if not shown_part or rank else 0, _hash(words[0], words[1], words[-1]) if len(words) > 2 else 0, _hash(words[0], words[-2], words[-1]) if len(words) > 2 else 0, before, 0, unit if rank else ""))
            before = h
    return out


_SCHEMA = "slot boolean, kind string, rank tinyint, page boolean, h bigint, one bigint, two bigint, ctx bigint, marker bigint, said string"
_TYPES = [pa.bool_(), pa.string(), pa.int8(), pa.bool_(), *[pa.int64()] * 5, pa.string()]


def aligned_units(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per unit, or per slot-like place of a unit: key, slot, kind, rank, page, h, one, two, ctx, marker, said.

    h, one and two hash the unit's words: all, the first two and the last, the first and the last two (of a unit with
    places, the words beside them). ctx hashes the words around a place, or the unit before a unit. rank is 3 for
    markers that only templates use, then 2, 1 and 0 as in MAYBE, RARELY and DEFAULT, and KNOWN, CUED or PLAIN for
    units. page tells that the text has page furniture; said is the words of a suspect unit or around a place. Null and
    blank texts have no rows.
    """
    names = [f.split()[0] for f in _SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at: list[int] = []
            rows: list[tuple] = []
            texts = b.column(1)
            for i in range(b.num_rows):
                t = texts[i].as_py()
                got = units(t) if t and not t.isspace() else []
                at.extend([i] * len(got))
                rows.extend(got)
                if rows and (len(rows) > 50_000 or i == b.num_rows - 1):
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int32()))] + [pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names=["key", *names])
                    at, rows = [], []

    return df.select(F.col(key).alias("key"), F.col(text).alias("t")).mapInArrow(run, f"key {df.schema[key].dataType.simpleString()}, {_SCHEMA}")


def induced_slots(rows: DataFrame) -> DataFrame:
    """The contexts of slot-like places: ctx, said, n_places, several (documents), differ (markers), top (rank)."""
    return rows.where("slot").groupBy("ctx").agg(
        F.min("said").alias("said"), F.count(F.lit(1)).alias("n_places"), (F.min("key") < F.max("key")).alias("several"), (F.min("marker") < F.max("marker")).alias("differ"), F.max("rank").alias("top")
    )


def _unfilled(rows: DataFrame) -> DataFrame:
    """(key, h, aligned) of the places that are proven to be unfilled slots."""
    places, plain = rows.where("slot"), rows.where("not slot")
    # records that fill the slot: units with the same words at both ends that differ between them
    doubtful = places.where("rank in (1, 2)")
    ends = doubtful.select(F.explode(F.array("one", "two")).alias("end")).where("end <> 0").distinct()
    filled = plain.select("h", F.explode(F.array("one", "two")).alias("end")).where("end <> 0").join(ends, "end", "left_semi").groupBy("end").agg(F.min("h").alias("x"), F.max("h").alias("y")).where("x < y").select("end", F.lit(True).alias("filled"))
    at = lambda side: filled.select(F.col("end").alias(side), F.col("filled").alias(f"filled_{side}"))
    told = places.join(induced_slots(rows).drop("said"), "ctx").join(at("one"), "one", "left").join(at("two"), "two", "left")
    by_filled = F.coalesce("filled_one", "filled_two", F.lit(False)) & F.col("rank").isin(1, 2)
    aligned = by_filled | (F.col("several") & (F.col("rank").isin(2, 3) | ((F.col("rank") == 1) & F.col("differ")) | (F.col("top") == 3)))
    return told.select("key", "h", "rank", aligned.alias("aligned")).where("aligned or rank = 3").select("key", "h", "aligned")


def _of(rows: DataFrame, kind: str) -> DataFrame:
    return rows.select("key", F.lit(kind).alias("kind"), "aligned")


def flag_residue(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kinds, proof) of each record whose text holds residue in whole or part; kinds is a sorted array.

    proof is 'aligned' if the corpus gave it, 'listed' if only a fixed value did. Null, empty and blank texts are no
    case, nor are texts that only quote or show such things. Repeated keys are one row, and one document. Only hashes
    of units are shuffled, not texts; groups are combined before each shuffle, so a unit that a third of all documents
    share is no hot group. Other columns are not read.
    """
    rows = Written(aligned_units(df, key, text)).df
    plain = rows.where("not slot and h <> 0")
    slots = Written(_unfilled(rows)).df
    # units with the words of a proven template and nothing in its slots
    blank = rows.where("not slot").join(slots.where("aligned and h <> 0").select("h").distinct(), "h", "left_semi").select("key", F.lit(True).alias("aligned"))
    cued = plain.where("rank > 0")
    repeated = cued.groupBy("h", "kind").agg((F.min("key") < F.max("key")).alias("aligned"))
    proven = Written(cued.join(repeated, ["h", "kind"]).where(F.col("aligned") | (F.col("rank") == KNOWN)).select("key", "kind", "aligned")).df
    pages = proven.select("key").distinct()
    # texts of furniture and repeated units only
    furnished = plain.where("page").join(pages, "key", "left_anti").select("key", "h")
    met = plain.join(furnished.select("h").distinct(), "h", "left_semi").groupBy("h").agg(F.min("key").alias("a"), F.max("key").alias("b")).where("a < b").select("h", F.lit(True).alias("again"))
    bare = Written(furnished.join(met, "h", "left").groupBy("key").agg(F.min(F.coalesce("again", F.lit(False))).alias("aligned")).where("aligned")).df
    # lines of several such texts that stand mostly there, and lines that stand nearly only beside proven units, in
    # different places of several documents
    of_bare = furnished.join(bare, "key", "left_semi").groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("a"), F.max("key").alias("b")).where("a < b").select("h", "n", F.lit(BARE_SHARE).alias("share"))
    beside = plain.join(pages, "key", "left_semi").groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("a"), F.max("key").alias("b"), F.min("ctx").alias("x"), F.max("ctx").alias("y")).where("a < b and x < y")
    told = Written(of_bare.unionByName(beside.select("h", "n", F.lit(PAGE_SHARE).alias("share")))).df
    everywhere = plain.join(told.select("h").distinct(), "h", "left_semi").groupBy("h").agg(F.count(F.lit(1)).alias("n_all"))
    page_lines = told.join(everywhere, "h").where(F.col("n") >= F.col("share") * F.col("n_all")).select("h").distinct()
    lines = plain.join(page_lines, "h", "left_semi").join(pages, "key", "left_anti").select("key", F.lit(True).alias("aligned"))
    found = _of(slots, "template").unionByName(_of(blank, "template")).unionByName(proven).unionByName(_of(lines, "page")).unionByName(_of(bare, "page"))
    return found.groupBy(F.col("key").alias(key)).agg(F.sort_array(F.collect_set("kind")).alias("kinds"), F.when(F.max("aligned"), "aligned").otherwise("listed").alias("proof"))
