"""Template residue and error-page text: unfilled slots, filler, error messages and notices that scripts are needed.

Texts are cut into segments (lines, then sentences, without tags and list marks). What is residue is learnt from
the whole corpus, by aggregates over segments:

* Slots. Segments of one template are aligned by masking what may vary: numbers, identifiers, addresses, names
  and marks. A mark is something that stands for a value: a variable in any of the common template notations, a
  default such as `undefined`, or a blank. Where records of a template hold different things in a place, the
  place is a slot, and a mark in it was left unfilled; segments are aligned a second time by the words around the
  mark only. Where all records hold the same mark, the segment itself decides: one that quotes the mark, is
  program source or says what marks are speaks of it, any other leaves it; a default that stays the same while
  numbers and identifiers beside it vary is a word of the text. Copies don't turn an answer.
* Pages. Some segments are of a page by their form: a line with an HTTP status, a notice in a `noscript` tag, the
  message of a JSON error body, keys pressed over and over, a line that only waits. Others by what they join: a
  thing that pages are about (page, server, session, scripts, text, ... in some twenty languages) with a state
  (not found, expired, must be enabled, goes here, ...), in a sentence in which nothing varies: no number,
  identifier, mark or quote. No sentence is known as such. From these the page templates are learnt: documents
  that mostly consist of lines in which nothing varies are pages; lines that stand in pages of at least PAGE_TEXTS
  different texts, mostly beside a certain one, are parts of the same templates, in any language, and so are
  status titles without their number. Learning is repeated, as each line learnt makes more pages certain.

A document is found if it holds a mark in a slot, a segment that is certain or a line that was learnt.
"""

from __future__ import annotations

import functools
import html
import json
import operator
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.functions.joins import on_groups
from evalspark.shared import spread, written

PAGE_TEXTS = 3
PAGE_SHARE = 0.5
ROUNDS = 3

_NAME = r"[^\W\d][\w .:|\-]*?"
# Fixed patterns: notations in which a variable stands in a template.
_MARKS = [
    r"\{\{\{\s*" + _NAME + r"\s*\}\}\}?",
    r"\{\{-?\s*" + _NAME + r"\s*-?\}\}",
    r"\{%-?\s*" + _NAME + r"\s*-?%\}",
    r"<%[=-]?\s*" + _NAME + r"\s*%>",
    r"<<\s*" + _NAME + r"\s*>>",
    r"\$\{\s*" + _NAME + r"\s*\}",
    r"#\{\s*" + _NAME + r"\s*\}",
    r"\$[A-Za-z_]{2,}\$",
    r"%%\s*[A-Za-z_]{2,}\s*%%",
    r"%\([A-Za-z_]+\)[sdrf]",
    r"%[A-Z][A-Z_]{2,}%",
    r"@@[A-Za-z_]{2,}@@",
    r"__[A-Za-z][A-Za-z_]+__",
    r"\[\[\s*" + _NAME + r"\s*\]\]",
    r"\[object object\]",
    r"\[(?:insert|your|enter|add)\b[^\[\]]+\]",
    r"\[[A-Z][A-Z]+(?:[ _\-]+[A-Z]+)*\]",
    r"(?<![A-Za-z0-9_\"'{\[$#%])\{[A-Za-z_]{2,}\}",
    r"<(?:your|insert|enter)\s[a-z _\-]{2,}>",
    r"\bundefined\b",
    r"_{3,}",
    r"\*\|\s*[A-Za-z_:]{2,}\s*\|\*",
    r"(?<![A-Za-z0-9_\"'{\[$#%.])\{\d{0,2}\}",
    r"\((?:[^\W\d][\w ]* )?(?:TODO|TBD)\)",
    r"\b(?:TODO|TBD|FIXME|XXX+)\b",
]
MARK = re.compile("|".join(f"(?:{m})" for m in _MARKS), re.I)
_IN_CAPITALS = [m for m in _MARKS if m.startswith((r"\[[A-Z]", "%[A-Z]", r"\b(?:TODO", r"\((?:[^"))]
_CASED = re.compile("|".join(f"(?:{m})" for m in _IN_CAPITALS))
_CASELESS = re.compile("|".join(f"(?:{m})" for m in _MARKS if m not in _IN_CAPITALS), re.I)

_TAG = re.compile(r"</?(?:html|head|title|body|h[1-6]|p|hr|br|div|span|noscript|strong|em|b|i|ul|ol|li|pre|code|main|section|center|meta|link|script|style|a)\b[^<>]*>", re.I)
_NOTICE = re.compile(r"<noscript\b[^<>]*>(.*?)(?:</noscript|$)", re.I | re.S)
# One short word, or a word and a number, over and over: keys pressed to fill a field.
_KEYS = re.compile(r"(?i)(?<!\w)(\w{1,8}(?: \d{1,4})?)(?:[\s,]+\1(?!\w)){4,}|(?:\.{3}\s+){4,}\.{3}")
_WIDE = re.compile("[\uff01-\uff5e]")
_BEFORE, _BEHIND = " \t\n\r\v\f>*#•-|=~", " \t\n\r\v\f*#|=~"
_SENTENCE = re.compile(r"(?<=[.!?…])\s+|(?<=[。！？।])\s*")
_RAISED = re.compile(r"^\w{0,30}(?:Error|Exception):\s+", re.I)
_SPLIT = re.compile(r"[\s!-/:-@\[-`{-~\u2010-\u203a\u3001\u3002\u0964\uff01-\uff20¿¡«»]+")
_VARIES = re.compile(r"\S+@\S+|#?\b[A-Z]{0,3}\d[\w.:/\-]*|\b[0-9a-f]{8,}\b|\b[a-z]+_[a-z]+_\d+\b")
_DIGIT = re.compile(r"\d")
_TITLE = re.compile(r"\b[^\W\d_a-z][^\W\d_A-Z]+\b")
_WORD = re.compile(r"\w+|\x01")
_MASKS = re.compile(r"\x01(?: \x01)+")
_QUOTES = "\"'`“”„‚‘’«»「」"

# Fixed words, parted by blanks; `_` is a blank between words, so `_page` begins a word and `_page_` is one, and `^`
# and `$` are the ends of a segment. In turn: English, German, French, Spanish, Portuguese, Italian, Dutch, Polish,
# Russian, Japanese, Chinese, Korean, Hindi, Turkish, Arabic.
# What pages, requests and their parts are called.
NET_THINGS = """
_page_ _pages_ _site_ _website_ _server _service_ _services_ _resource _request_ _requests_ _connection _gateway _session _access_ _database _content_ _dashboard _viewer
_seite _dienst _sitzung _zugriff _anfrage _verbindung _serveur _accès_ _requête _connexion _página _sitio _servidor _servicio _sesión _acceso _solicitud _conexión
_serviço _sessão _acesso _pedido _pagina _sito_ _servizio _sessione _accesso _richiesta _sessie _toegang _verzoek _stron _serwer _usług _sesj _dostęp
страниц сервер сервис сеанс доступ запрос соединени ページ サーバ サービス セッション アクセス 页面 頁面 网页 網頁 服务器 伺服器 服务 服務 会话 访问 存取 请求
페이지 서버 서비스 세션 접근 액세스 요청 पृष्ठ सर्वर सेवा सत्र पहुँच _sayfa _sunucu _hizmet _oturum _erişim الصفحة الخادم الخدمة الجلسة الوصول
"""
# What is said of one that fails.
NET_STATES = """
_not_found _not_be_found _denied _forbidden _unavailable _expired _has_ended _error_ _failed _time_out _timed_out _timeout _reset_ _blocked _was_moved _not_exist _no_longer _not_respond _not_answer _not_be_reached _not_working
_t_be_reached _t_work _isn_t_working _t_be_found _t_exist _t_respond _closed_the _too_many _maintenance _bad_ _unauthorized _unauthorised _permission _trouble _unexpected _not_be_completed _stopped_the _establishing
_verweigert _nicht_verfügbar _nicht_gefunden _abgelaufen _existiert_nicht _antwortet_nicht fehler _zeitüberschreitung _gesperrt _wartung _refusé _indisponible _introuvable _expiré _n_existe _ne_répond _erreur _interdit
_denegado _no_disponible _no_encontrad _caducad _expirad _no_existe _no_responde _error_interno _prohibid _negado _indisponível _não_encontrad _expirou _não_existe _não_responde _erro_intern _proibid
_non_trovat _non_è_stata_trovat _non_è_stato_trovat _non_disponibil _non_è_disponibil _non_esist _non_rispond _negat _scadut _errore _vietat _niet_gevonden _niet_beschikbaar _geweigerd _verlopen _bestaat_niet _reageert_niet _fout_
_nie_znaleziono _nie_istnieje _nie_odpowiada _nie_jest_dostępn _wygasł _błąd _odmow запрещ не_найден не_существ недоступ завершён истек не_отвечает ошибк 見つかりません 存在しません 拒否 利用できません 切れました 応答 エラー
未找到 找不到 不存在 拒绝 拒絕 禁止 不可用 过期 過期 超时 错误 錯誤 没有响应 찾을_수_없 거부 사용할_수_없 만료 오류 응답 नहीं_मिला अस्वीकृत उपलब्ध_नहीं समाप्त त्रुटि उत्तर_नहीं
_bulunamadı _reddedildi _kullanılamıyor _doldu _hata _yanıt_vermiyor غير_موجود مرفوض غير_متاح انتهت خطأ لا_يستجيب
"""
# What asks to come back or to go elsewhere, or only exclaims, or only waits.
ALONE = """
^_try_again_in_a ^_please_try_again ^_try_again_later _something_went_wrong _etwas_ist_schief _be_back_shortly _be_back_soon _start_page_or_use_the_search _contact_the_site_owner _contact_the_server_admin _contact_the_system_admin ^_you_have_been_blocked
_später_erneut _réessayer_plus _más_tarde _mais_tarde _de_novo_mais _più_tardi _later_opnieuw _ponownie_później повторите_попытку попробуйте_позже もう一度お試し 稍后 稍後 다시_시도 फिर_कोशिश _daha_sonra_tekrar
^_oops_$ ^_ups_$ ^_hoppla_$ ^_loading_$ ^_please_wait_$ ^_wird_geladen_$ ^_bitte_warten_$ ^_cargando_$ ^_chargement_$ ^_a_carregar_$ ^_carregando_$ ^_caricamento_$ ^_laden_$ ^_ładowanie_$ ^_загрузка_$ ^_読み込み中_$ ^_加载中_$ ^_載入中_$ ^_로드_중_$ ^_लोड_हो_रहा_है_$ ^_yükleniyor_$ ^_جار_التحميل_$
"""
SCRIPT_THINGS = "javascript java_script _js_ _script_ _scripts_ _scripting_ _skript スクリプト скрипт स्क्रिप्ट 脚本 腳本 스크립트 _cookie_ _cookies_ _your_browser_before"
SCRIPT_STATES = """
_enable _disabled _turn_on _turn_off _turned_on _turned_off _switch_on _switch_off _switched_on _switched_off _require_ _requires_ _required _need_ _needs_ _activate _allow _blocked _not_run _not_support _only_with _checking
_aktivier _benötigt _ausgeschaltet _deaktiviert _activ _nécessite _désactiv _necesita _desactiv _habilit _ative _precisa _requer _attiv _abilit _richied _disattiv _inschakel _schakel _vereist _uitgeschakeld _włącz _wymaga _wyłącz
включите отключен нужн требу 有効 無効 必要 启用 啟用 禁用 需要 활성 사용하도록 필요 비활성 चालू बंद आवश्यक ज़रूर _etkinleştir _gerekl _devre_dışı تفعيل تمكين معطل
"""
FILLER_THINGS = """
text_ _content_ _body_ _paragraph _sentence _description_ _summary_ _heading _headline _title_ _copy_ _section_ _texte _texto _textos _beschreibung absatz _inhalt _contenu _paragraphe _contenido _descripción _párrafo _conteúdo _descrição _parágrafo
_testo _contenuto _descrizione _paragrafo _tekst _inhoud _beschrijving _treść _opis_ текст описани 本文 説明 テキスト 文本 内容 描述 텍스트 내용 설명 पाठ विवरण _metin _metni _açıklama
"""
FILLER_STATES = """
_goes_here _comes_here _go_here dummy placeholder filler _sample_ _example_sentence _example_text _example_paragraph coming_soon _to_be_written _to_be_added _to_be_replaced _to_be_done replace_before _later_$ in_this_box for_the_layout _one_$ _two_$ _three_$
platzhalter blindtext mustertext hier_steht hier_kommt _folgt beispiel de_relleno de_ejemplo aquí_va pendiente vient_ici à_compléter de_remplissage d_exemple faux_texte exemple_de entra_aqui por_escrever de_exemplo
segnaposto di_esempio _qui_va _va_qui da_completare voorbeeld komt_hier _volgt opvul przykład _tutaj _uzupełn здесь_будет будет_позже для_примера 入ります 追加 サンプル 占位 示例 在此 在这里 待补 여기에 예시 자리 यहाँ नमूना बाद_में _buraya _örnek yer_tutucu
"""
# The Latin filler texts: a first and a second word of them.
LATIN, LATIN_TOO = "_lorem_ _dolor_ _perspiciatis_", "_ipsum_ _amet_ _unde_omnis_"
_KINDS = {name: 1 << i for i, name in enumerate(("net", "fails", "alone", "script", "switched", "filler", "goes here", "latin", "latin too"))}
_WORDS_OF = dict(zip(_KINDS, (NET_THINGS, NET_STATES, ALONE, SCRIPT_THINGS, SCRIPT_STATES, FILLER_THINGS, FILLER_STATES, LATIN, LATIN_TOO), strict=True))
_PAIRS = [_KINDS["net"] | _KINDS["fails"], _KINDS["script"] | _KINDS["switched"], _KINDS["filler"] | _KINDS["goes here"], _KINDS["alone"], _KINDS["latin"] | _KINDS["latin too"]]
_STATUS_AHEAD, _STATUS_BEHIND = re.compile(r"(?:[^\W\d]{2,10}\s*)?[45]\d\d\b\s*[:\-–—]?\s*"), re.compile(r"\s*\(?\b[45]\d\d\)?$")


@functools.cache
def _finder():
    """An automaton that finds all fixed words in one pass."""
    import ahocorasick

    found: dict[str, int] = {}
    for kind, words in _WORDS_OF.items():
        for word in words.split():
            word = word.replace("_", " ")
            found[word] = found.get(word, 0) | _KINDS[kind]
    finder = ahocorasick.Automaton()
    for word, kinds in found.items():
        finder.add_word(word, (kinds, len(word)))
    finder.make_automaton()
    return finder


def said(bare: str) -> tuple[int, bool]:
    """(the kinds of fixed words a segment holds as bits, whether a failing state is all there is)."""
    text = "^ " + " ".join(_SPLIT.sub(" ", bare).split()) + " $"
    kinds, whole = 0, False
    for end, (kind, length) in _finder().iter(text):
        kinds |= kind
        whole |= bool(kind & _KINDS["fails"]) and end - length < 2 and end + 3 >= len(text)
    return kinds, whole


def plain_text(text: str) -> str:
    """Entities, wide forms and the many blanks of Unicode in their plain form; line ends stay."""
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = re.sub(r"[^\S\n\r]", " ", text)
        text = _WIDE.sub(lambda m: chr(ord(m[0]) - 0xFEE0), text)
    return text


def whole_text_residue(text: str) -> bool:
    """Notices in their own tag, and filler of pressed keys, wherever they stand."""
    text = plain_text(text)
    notice = _NOTICE.search(text) if "<noscript" in text.lower() else None
    if notice is not None and notice.group(1).strip() != "":
        return True
    # Keys pressed over and over are words that are the same as the next one or the one after it.
    words = text.casefold().replace(",", " ").split()
    return (any(map(operator.eq, words, words[1:])) or any(map(operator.eq, words, words[2:]))) and _KEYS.search(text) is not None


def segments(text: str) -> list[str]:
    """Lines and sentences without tags, list marks, wrappers and repeated blanks."""
    text = plain_text(text)
    if "<" in text:
        text = _TAG.sub("\n", text)
    found = []
    for line in text.splitlines():
        line = _edges(line)
        if not line:
            continue
        for part in _messages(line) if line[0] == "{" else (_RAISED.sub("", line) if ": " in line else line,):
            for sentence in _SENTENCE.split(part):
                if sentence := _edges(" ".join(sentence.split())):
                    found.append(sentence)
    return found


def _edges(line: str) -> str:
    """A line without blanks and marks of lists, quotes and headings around it."""
    return line.lstrip(_BEFORE).rstrip(_BEHIND)


def _messages(line: str) -> list[str]:
    """The texts in a JSON error body; any other line as it is."""
    try:
        value = json.loads(line)
    except (ValueError, RecursionError):
        return [line]
    if not isinstance(value, dict) or not {k.lower() for k in value} & {"error", "errors", "message", "detail", "status"}:
        return [line]
    texts, left = [], [value]
    while left:
        inner = left.pop()
        if isinstance(inner, dict):
            left.extend(inner.values())
        elif isinstance(inner, list):
            left.extend(inner)
        elif isinstance(inner, str):
            texts.append(inner)
    return texts


_TRIGGER = re.compile(r"[{\[<$%]|@@|__|\*\||undefined|TODO|TBD|FIXME|XXX", re.I)


def marks(segment: str) -> list[tuple[int, int]]:
    """Spans of the marks. Capitals-only notations count in capitals; where all is in capitals they count too."""
    if not _TRIGGER.search(segment):
        return []
    found = [m.span() for m in _CASELESS.finditer(segment)]
    for m in _CASED.finditer(segment):
        if not any(a < m.end() and m.start() < b for a, b in found):
            found.append(m.span())
    return sorted(found)


def varied(text: str) -> bool:
    """Whether a text may hold a number, an identifier or an address, so that masking it is worth a look."""
    return "@" in text or _DIGIT.search(text) is not None


def template(segment: str, spans: list[tuple[int, int]]) -> tuple[str, list[tuple[str, str]]]:
    """(the segment with everything that may vary masked, (the mark, the words around it) of each span)."""
    parts, at = [], 0
    for a, b in spans:
        parts += [segment[at:a], "\x01"]
        at = b
    masked = "".join([*parts, segment[at:]])
    masked = _VARIES.sub("\x02", masked) if varied(masked) else masked
    lower = masked.upper() != masked
    masked = _TITLE.sub("\x02", masked) if lower else masked
    masked, places = masked.casefold(), []
    if spans:
        words = _WORD.findall(masked.replace("\x02", " "))
        around = [" ".join(words[max(0, p - 2) : p + 3]) for p, w in enumerate(words) if w == "\x01"]
        places = list(zip(("".join(segment[a:b].split()).casefold() for a, b in spans), around, strict=False))
    key = " ".join(_WORD.findall(masked.replace("\x02", "\x01")))
    return _MASKS.sub("\x01", key), places


# Fixed words for what marks are and stand in, when a text speaks of them.
_SPEAKING = re.compile(
    r"(?i)\b(?:placeholder|template|variable|column|macro|script|syntax|platzhalter|vorlage|spalte|skript|la marque|plantilla|segnaposto|szablon|шаблон|переменн)\w*|\b(?:replaced?|replaces|stands for|means|on purpose|type (?:your|the|a))\b"
)
LEAVES, BESIDE, SPEAKS = 0, 1, 2
# Defaults that are words a text may also use as such.
_DEFAULT = re.compile(r"(?i)\[object object\]|undefined|TODO|TBD|FIXME|XXX+")


def spoken_of(segment: str, spans: list[tuple[int, int]]) -> int:
    """SPEAKS if a segment quotes its marks, is program source, or says what they are; BESIDE if its marks are defaults
    and values are filled in beside them, so that other records must tell; else LEAVES."""
    quoted = all(segment[a - 1 : a] in _QUOTES and segment[b : b + 1] in _QUOTES and a > 0 for a, b in spans) and not segment.lstrip().startswith("{")
    bare = list(segment)
    for a, b in spans:
        bare[a:b] = " " * (b - a)
    rest = "".join(bare)
    filled = varied(rest) and _VARIES.search(rest) is not None
    if quoted or _SOURCE.search(segment) or _SPEAKING.search(rest):
        return SPEAKS
    return BESIDE if filled and all(_DEFAULT.fullmatch(segment[a:b]) for a, b in spans) else LEAVES


# Program source: a string that is formatted, a call, an assignment that ends a statement.
_SOURCE = re.compile(r"""\b[frb]["']|\w\(["'][^"']*["'][,)]|;\s*$""")
_QUOTED = re.compile('["`“”„«»「」]')
_SPEAKER = re.compile(r"(?:User|Agent|Tool|System)\b")
_CODED = re.compile(r"(?:\S+ ?){0,6}")


def untitled(segment: str) -> str:
    """A segment without the number of an HTTP status before or behind it, in lower case, without its last point."""
    bare = segment.casefold().rstrip(" .!…:。！।")
    if ahead := _STATUS_AHEAD.match(bare):
        return bare[ahead.end() :].strip()
    return _STATUS_BEHIND.sub("", bare, count=1).strip() if bare[-1:].isdigit() or bare.endswith(")") else bare


def constant(segment: str) -> bool:
    """Whether nothing in the segment varies: no numbers, quotes, identifiers or speakers."""
    return not (_DIGIT.search(segment) or _QUOTED.search(segment) or ("@" in segment and _VARIES.search(segment)) or _SPEAKER.match(segment))


# Fixed words that are written with a capital inside a sentence without being a name.
_CAPITALS = {"sie", "ihr", "ihre", "ihrem", "ihren", "ihrer", "browser", "layout", "administrator", "url", "internet", "web", "java", "nginx", "apache"}


def named(segment: str) -> bool:
    """Whether a sentence holds a name: a word with a capital, not the first, that is no fixed word; titles and capitals throughout hold none."""
    words = segment.split()
    if not words or segment.upper() == segment or sum(w[:1].isupper() for w in words) * 2 > len(words):
        return False
    inside = [w for w in _WORD.findall(segment.partition(" ")[2]) if w[0].isupper() and w.casefold() not in _CAPITALS]
    return any(not said(w.casefold())[0] for w in inside)


def page_segment(segment: str) -> bool:
    """Whether the segment by itself is an error title or message, a script notice, filler or a line that waits."""
    bare = untitled(segment)
    if not constant(bare):
        return False
    kinds, whole = said(bare)
    if not kinds:
        return False
    coded = len(bare) < len(segment.rstrip(" .!…:。！।")) and kinds & _KINDS["fails"]
    if whole or (coded and _CODED.fullmatch(bare)):
        return True
    return any(kinds & pair == pair for pair in _PAIRS) and not named(segment)


def page_form(segment: str) -> bool:
    """Whether a line has the form of a status title: an HTTP status and at most a few words, whatever the language."""
    if not _DIGIT.search(segment):
        return False
    bare = untitled(segment)
    return 0 < len(bare) < len(segment.rstrip(" .!…:。！।")) and _CODED.fullmatch(bare) is not None and constant(bare)


EVIDENCE = "doc_id bigint, kind string, key bigint, place int, local bigint, value bigint, body bigint, flag int"
_EVIDENCE_ARROW = pa.schema([("doc_id", pa.int64()), ("kind", pa.string()), ("key", pa.int64()), ("place", pa.int32()), ("local", pa.int64()), ("value", pa.int64()), ("body", pa.int64()), ("flag", pa.int32())])


def number(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - 2**63


@functools.lru_cache(maxsize=50_000)
def reading(segment: str) -> tuple[str, tuple, bool, bool]:
    """(kind, found, certain, form) of a segment by itself, remembered as many segments recur.

    found is a (key, place, around, value, segment, about) for each mark of a `mark`, else a key: of the words of a
    `line`, in which nothing varies, or of the template of a `plain` segment.
    """
    if spans := marks(segment):
        key, found = template(segment, spans)
        about, body = spoken_of(segment, spans), number(segment)
        return "mark", tuple((number(key), i, number(around), number(value), body, about) for i, (value, around) in enumerate(found)), False, page_form(segment)
    if (bare := untitled(segment)) and constant(bare):
        return "line", (number(bare),), page_segment(segment), page_form(segment)
    return "plain", (number(template(segment, [])[0]),), False, page_form(segment)


def evidence(documents: DataFrame) -> DataFrame:
    """What each segment says for or against residue.

    kind `page`: certainly of a page. `line`: a segment in which nothing varies; body is the hash of its text,
    value 1 if a certain one stands beside it and at least half of the document are such lines, so that it may be a
    page as a whole, flag 1 if it has the form of a status title. `mark`: one mark, with its template, place, surroundings, value and segment
    (body), flag what `spoken_of` says. `plain`: a template that occurs without marks (once a batch, without document).
    """

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, plain = [], set()
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                parts = list(dict.fromkeys(segments(text)))
                read = [reading(part) for part in parts]
                by_tag = whole_text_residue(text)
                n_sure = sum(sure or form for _, _, sure, form in read) + by_tag
                if by_tag or any(sure for _, _, sure, _ in read):
                    rows.append((doc, "page", None, None, None, None, None, None))
                page = 2 * sum(kind == "line" for kind, *_ in read) >= len(parts)
                body = number("\n".join(parts))
                for kind, found, sure, form in read:
                    if kind == "mark":
                        rows += [(doc, "mark", *one) for one in found]
                    elif kind == "line" and not sure:
                        rows.append((doc, "line", found[0], None, None, int(page and n_sure - form > 0), body, int(form)))
                    elif kind == "plain":
                        plain.add(found[0])
            rows += [(None, "plain", key, None, None, None, None, None) for key in plain]
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(_EVIDENCE_ARROW)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _EVIDENCE_ARROW, strict=True)], schema=_EVIDENCE_ARROW)

    return spread(documents.select("doc_id", "text").where("text is not null and text <> ''")).mapInArrow(convert, EVIDENCE)


def learnt_lines(lines: DataFrame) -> DataFrame:
    """(key) of the lines that page templates consist of.

    `lines` are (key, body, sure, form) of all texts. Copies of a text count once. A line is learnt if at
    least PAGE_TEXTS texts hold it and PAGE_SHARE of them are certain without it; a status title also counts for
    itself, if the same words stand under a status in as many texts. What was learnt makes pages certain in the
    next round.
    """
    pages = written(lines.groupBy("body", "key").agg(F.max("sure").alias("sure"), F.max("form").alias("form")), "residue-pages")
    known = None
    for _ in range(ROUNDS):
        marked = pages.withColumn("learnt", F.lit(0))
        if known is not None:
            marked = on_groups(pages, known.withColumn("learnt", F.lit(1)), ["key"], "left").na.fill(0, ["learnt"])
        whole = marked.groupBy("body").agg(F.sum("learnt").alias("n_learnt"))
        beside = on_groups(marked, whole, ["body"]).withColumn("paged", F.greatest("sure", (F.col("n_learnt") > F.col("learnt")).cast("int"), "form"))
        seen = beside.groupBy("key").agg(F.count("*").alias("n"), F.sum("paged").alias("paged"))
        known = written(seen.where((F.col("n") >= PAGE_TEXTS) & (F.col("paged") >= PAGE_SHARE * F.col("n"))).select("key"), "residue-learnt")
    return known


def residue_documents(documents: DataFrame) -> DataFrame:
    """(doc_id) of each document that consists of residue or holds it in place of content in any part.

    Null, empty and blank texts are no cases; a document is found once however much residue it holds; an empty
    table gives no rows.
    """
    all_ = written(evidence(documents), "residue-evidence")

    found = all_.where("kind = 'mark'").select("doc_id", "key", "place", "local", "value", "body", F.col("flag").alias("about"))
    varies = lambda c: F.min(c) != F.max(c)
    by_key = found.groupBy("key", "place").agg(varies("value").alias("key_varies"), varies("body").alias("aligned"))
    by_local = found.groupBy("local").agg(varies("value").alias("local_varies"), varies("body").alias("local_aligned"))
    left = found.where(F.col("about") == LEAVES).select("local", "value").distinct().withColumn("left", F.lit(True))
    plain = all_.where("kind = 'plain'").select("key").distinct().withColumn("filled", F.lit(True))
    # Null-safe keys need exchanges of their own, so a template of a third of the documents is split over tasks.
    judged = on_groups(on_groups(found, by_key, ["key", "place"]), by_local, ["local"])
    judged = on_groups(on_groups(judged, left, ["local", "value"], "left"), plain, ["key"], "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    text = (F.col("about") == SPEAKS) | ((F.col("about") == BESIDE) & (F.col("aligned") | F.col("local_aligned")))
    unfilled = judged.where(yes("filled") | F.col("key_varies") | F.col("local_varies") | yes("left") | ~text).select("doc_id")

    lines = all_.where("kind = 'line'").select("doc_id", "key", "body", F.col("value").alias("sure"), F.col("flag").alias("form"))
    learnt = learnt_lines(lines.drop("doc_id"))
    induced = on_groups(lines, learnt.withColumn("learnt", F.lit(True)), ["key"]).select("doc_id")
    certain = all_.where("kind = 'page'").select("doc_id")
    return unfilled.unionByName(induced).unionByName(certain).distinct()


def without_residue(documents: DataFrame) -> DataFrame:
    """The documents that hold no residue, all columns kept."""
    return documents.join(residue_documents(documents), "doc_id", "left_anti")
