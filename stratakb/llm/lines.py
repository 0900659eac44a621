"""What the lines of a text taken from a web page look like: code, table, heading, list, prose, page furniture."""

from __future__ import annotations

import re
from functools import lru_cache

FENCE = re.compile(r"\s*(```|~~~)")
HEADING = re.compile(r"\s*#{1,6}(\s|$)")
TABLE = re.compile(r"\s*\|.*\|\s*$|\s*\|?\s*:?-{3,}:?\s*(\|\s*:?-{3,}:?\s*)+\|?\s*$")
ITEM = re.compile(r"\s*([-*+•→‣▪]|\d{1,3}[.)])\s+(?=\S)")
END = re.compile(r"[.!?。！？؟।]['\"”’»)\]*_`]*\s*$")
SEPARATOR = re.compile(r"\s*[|·•/»›>]\s*|\s{2,}")
CJK = re.compile(r"[一-鿿぀-ヿ가-힯]")

# What the furniture of web pages says, by kind, in the languages of the corpus and a few
# common variants. Matched against a whole line in lower case without list marks and closing stops.
PHRASES = {
    "skip": r"(skip|jump) to (the )?(main )?(content|navigation|search)|toggle (navigation|menu)|(back to|return to|go to) (the )?top|print( this page)?|open menu|close menu|menu"
    r"|跳到正文|跳至内容|跳转到内容|返回顶部|回到顶部|切换导航|打印本页|打印|zum (inhalt|hauptinhalt) springen|nach oben|seite drucken|navigation (umschalten|öffnen)|drucken"
    r"|aller au contenu( principal)?|haut de page|retour en haut|imprimer( cette page)?|(ouvrir|afficher) (le menu|la navigation)|saltar al contenido( principal)?|ir al contenido|volver arriba|imprimir( esta página)?|abrir (el )?menú|mostrar navegación",
    "related": r"popular (this week|now|posts|pages)|most (read|popular|viewed)|related (articles|posts|pages|content|topics)|(read|up) next|(you may|you might) also (like|enjoy)|more (from this author|like this|articles|on this topic)|recommended( for you)?|trending( now)?|see also|latest posts"
    r"|热门推荐|热门文章|相关(文章|阅读|推荐|页面)|猜你喜欢|推荐阅读|延伸阅读|下一篇|(作者的|该作者的|同一作者的)?(更多|其他)文章|最多阅读|本周热门|您可能还喜欢"
    r"|ähnliche (beiträge|artikel|seiten)|meistgelesen|beliebt( diese woche)?|das könnte (sie|dich) (auch )?interessieren|mehr (von diesem autor|zum thema|artikel)|weiterlesen|verwandte (artikel|beiträge|themen)|als nächstes lesen|auch interessant|lesen sie auch"
    r"|articles (liés|similaires|connexes|populaires)|à lire (aussi|ensuite|également)|les plus lus|populaires?( cette semaine)?|du même auteur|vous aimerez aussi|sur le même (sujet|thème)|voir aussi"
    r"|artículos (relacionados|populares)|lo más (leído|visto|popular)|también (le|te) puede interesar|leer (también|a continuación)|más (de este autor|artículos|sobre este tema)|le puede interesar|populares?( esta semana)?|a continuación|ver también|siga leyendo",
    "share": r"share( this| on| via)?( page| article| post)?( ?:.*)?|copy link.*|save for later.*|report (a problem|this page).*|follow us.*|tweet|e-?mail this( page)?|show all \d+ (replies|comments)|cite this page|edit this page|bookmark this page"
    r"|(分享|转发)(本页|此页|到)?([：:].*)?|关注我们.*|复制链接.*|收藏.*|报告问题.*|显示全部.*|查看全部.*|seite teilen.*|teilen( auf)?.{0,40}|link kopieren.*|folgen sie uns.*|problem melden.*|alle \d+ antworten( anzeigen)?|partager( cette page)?( ?:.*)?|copier le lien.*|suivez-nous.*|signaler un problème.*|(afficher|voir) les \d+ réponses"
    r"|compartir( esta página)?( ?:.*)?|copiar (el )?enlace.*|síganos.*|síguenos.*|informar de un problema.*|(ver|mostrar) (las|todas las) \d+ respuestas",
    "newsletter": r"(subscribe|sign up)( to our (newsletter|mailing list)| for updates| now)?|(join (our|\d+|[\d,.]+k?)).{0,60}|get one mail.*|.{0,60}(no spam|unsubscribe (at )?any ?time).{0,60}|your e-?mail address.*|newsletter"
    r"|订阅.{0,20}|.{0,30}(不发垃圾邮件|随时退订|输入您?的?邮箱).{0,20}|newsletter abonnieren.*|abonnieren.{0,40}|.{0,50}(kein spam|jederzeit abbestellbar|ihre e-mail-adresse).{0,40}|abonnez-vous.{0,60}|.{0,60}(pas de spam|sans spam|votre adresse e-?mail|désinscription).{0,40}|s'abonner.*"
    r"|suscr(í|i)base.{0,60}|suscribirse.*|.{0,60}(sin spam|su correo electrónico|darse de baja).{0,40}|(rejoignez|schließen sie sich|werden sie einer|únase a|únete a|加入).{0,60}\d.{0,40}|un (mail|correo|courriel) .{0,60}(semaine|semana).{0,40}|eine (e-)?mail (pro|die) woche.{0,60}|每周一封.{0,40}",
    "ad": r"(advertisement|sponsored( content| links?)?|promoted|ads?|ad choices)|广告|赞助(内容|商)?|推广|anzeigen?|werbung|gesponsert|publicité|sponsorisé|annonces?|contenu sponsorisé|publicidad|patrocinado|anuncios?|contenido patrocinado",
    "rating": r"(was|did you find) this (page|article) (helpful|useful).{0,30}|rate this\b.{0,40}|.{0,20}(有帮助|有用)吗.{0,12}|(为|给)本(页|文)评分.*|war diese seite (hilfreich|nützlich).{0,20}|(diese )?seite bewerten.*|(cette page vous a-t-elle aidé|cet article vous a-t-il (été utile|aidé)).{0,20}|notez cet(te)? .{0,20}|¿?(le|te) ha (sido útil|servido) (esta|este) .{0,30}|valore (esta|este) .{0,20}",
    "comments": r"(show |view |hide |all )*\d* ?(comments?|replies)( \(\d+\))?|(leave|add|write|post) a (comment|reply)|(log|sign) in to (comment|reply).{0,10}|共? ?\d+ ?条(评论|回复)|(发表|查看)评论|登录后(发表)?评论|\d+ (kommentare?|antworten)|kommentar (schreiben|hinterlassen)|\d+ (commentaires?|réponses?)|(laisser|écrire|ajouter) un commentaire|\d+ (comentarios?|respuestas?)|(dejar|escribir|añadir) un comentario",
    "paging": r"(previous|prev|« ?previous|‹ ?prev)?[\s\d.…|·‹›«»<>-]*(next)?( page| ?[›»])?|page \d+ (of|/) \d+|\d+ (of|/) \d+|(上一页)?[\s\d.…]*(下一页)?|第 ?\d+ ?页.{0,10}|(zurück)?[\s\d.…]*(weiter)?|seite \d+ (von|/) \d+|(précédent)?[\s\d.…]*(suivant)?|page \d+ (sur|/) \d+|(anterior)?[\s\d.…]*(siguiente)?|página \d+ (de|/) \d+",
    "reading": r"(estimated )?reading time.{0,20}|(tags|filed under|posted in) ?: ?\d+ more|tags ?: ?\d+.{0,12}|(schlagwörter|étiquettes|etiquetas|mots-clés|标签)[ ：:]+.{0,20}\d+.{0,12}|\d+ min(ute)?s? read|download (as )?pdf|last (updated|modified)( on)? ?:? ?[\d./ -]+|阅读时间.{0,12}|下载 ?pdf|(geschätzte )?lesezeit.{0,20}|als pdf (herunterladen|speichern)|temps de lecture.{0,20}|télécharger (en|le) pdf|tiempo de lectura.{0,20}|descargar (en|como)? ?pdf",
    "copyright": r"(©|\(c\)|copyright\b|版权所有).{0,90}|.{0,60}(all rights reserved|alle rechte vorbehalten|tous droits réservés|todos los derechos reservados|版权所有|保留所有权利)",
    "button": r"(accept|allow|reject|decline|refuse)( all)?( cookies)?|got it|ok(ay)?|i (agree|accept|understand)|(only necessary|necessary only|essential only)|(more options|manage (choices|preferences|cookies|options)|customi[sz]e|settings)|知道了|zustimmen|einverstanden|(全部)?(接受|拒绝|同意)|仅(限)?必要(项|的)?( cookie)?|更多选项|(alle )?(akzeptieren|ablehnen|annehmen)|verstanden|nur (notwendige|erforderliche)|(weitere optionen|einstellungen)|(tout )?(accepter|refuser)|j'ai compris|continuer sans accepter|uniquement (les )?nécessaires|(personnaliser|plus d'options)|(aceptar|rechazar)( todo| todas)?|entendido|(solo|sólo) las necesarias|(configurar|más opciones)",
    "consent": r"(we|this (web ?)?(site|page)|our (site|website)|cookies) (and our [\w ]+ )?(use|uses|set|store|stores|place|places|help|process)\b.{0,140}|your privacy (matters|is important|settings).{0,100}|before you continue.{0,140}|by (staying|continuing|using|browsing|clicking).{0,100}(agree|accept|consent).{0,60}"
    r"|.{0,30}(我们|本站|本网站|继续浏览).{0,40}cookies?.{0,60}|.{0,20}(重视|尊重)您的隐私.{0,40}|(wir|diese (web)?seite) (und unsere .{0,30} )?(verwenden|verwendet|nutzen|nutzt|setzen|setzt|speichert)\b.{0,30}(cookies?|dateien|daten).{0,90}|ihre privatsphäre.{0,90}|mit (dem|ihrem) (weiteren )?besuch.{0,90}"
    r"|(nous|ce site|notre site).{0,40}(cookies?|traceurs|témoins).{0,90}|votre vie privée.{0,90}|en (poursuivant|continuant).{0,60}(acceptez|cookies?).{0,60}|(usamos|utilizamos|este sitio (usa|utiliza|guarda)|nosotros y nuestros).{0,40}(cookies?|rastreadores|archivos|datos|socios).{0,90}|su privacidad.{0,90}|al (continuar|seguir) .{0,60}(acepta|cookies?).{0,60}",
}
def alternatives(source: str) -> list[str]:
    """The alternatives of a pattern at its outermost level."""
    out, depth, inside, start, i = [], 0, False, 0, 0
    while i < len(source):
        c = source[i]
        if c == "\\":
            i += 1
        elif inside:
            inside = c != "]"
        elif c == "[":
            inside = True
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "|" and not depth:
            out.append(source[start:i])
            start = i + 1
        i += 1
    return [*out, source[start:]]


def _by_length(body: str) -> list[tuple[re.Pattern, int]]:
    """A pattern in two: the alternatives that fit up to some length, with that length, and those that fit any."""
    widths = [(x, re._parser.parse(x).getwidth()[1]) for x in alternatives(body)]
    bounded, free = [(x, n) for x, n in widths if n < 10_000], [x for x, n in widths if n >= 10_000]
    out = [(re.compile("|".join(x for x, _ in bounded)), max(n for _, n in bounded))] if bounded else []
    return out + ([(re.compile("|".join(free)), 2**31)] if free else [])


PHRASE = [(kind, re.compile(rf"(?:{body})")) for kind, body in PHRASES.items()]
PHRASE_PARTS = [(kind, part, most) for kind, body in PHRASES.items() for part, most in _by_length(body)]
# Entries of navigation and of legal menus.
NAVIGATION = set(
    "home|docs|documentation|blog|forum|forums|contact|contact us|support|help|pricing|status|search|guides|careers|jobs|changelog|community|about|about us|sign in|sign up|log in|login|register|api reference|api|tutorials|downloads|download|partners|news|press|faq|products|features|team|events|archive|categories|tags|settings|account|my account|login / register"
    "|首页|主页|文档|博客|论坛|联系我们|帮助|支持|价格|状态|搜索|指南|招聘|更新日志|社区|关于我们|关于|登录|注册|教程|下载|合作伙伴|新闻|常见问题|产品"
    "|startseite|dokumentation|kontakt|hilfe|preise|suche|anleitungen|karriere|gemeinschaft|über uns|anmelden|registrieren|neuigkeiten|presse|produkte|änderungen"
    "|accueil|aide|tarifs|recherche|guides|carrières|communauté|à propos|connexion|s'inscrire|téléchargements|partenaires|actualités|tutoriels|produits"
    "|inicio|documentación|foro|contacto|ayuda|soporte|precios|buscar|guías|empleo|comunidad|quiénes somos|acerca de|entrar|iniciar sesión|registrarse|descargas|socios|noticias|tutoriales|productos|novedades".split("|")
)
LEGAL = set(
    "terms of use|terms of service|terms|terms and conditions|privacy|privacy policy|sitemap|site map|imprint|accessibility|cookie settings|cookies|cookie policy|do not sell my data|legal notice|legal|disclaimer"
    "|隐私政策|法律声明|使用条款|服务条款|网站地图|cookie 设置|cookie设置|免责声明|无障碍|agb|impressum|barrierefreiheit|datenschutz|datenschutzerklärung|nutzungsbedingungen|cookie-einstellungen|cookies verwalten|rechtliches"
    "|mentions légales|conditions|conditions d'utilisation|plan du site|confidentialité|politique de confidentialité|accessibilité|gérer les cookies|cookies|condiciones|condiciones de uso|aviso legal|configurar cookies|mapa del sitio|privacidad|política de privacidad|accesibilidad|términos".split("|")
)
BARE = re.compile(r"^[\s>*#|\-+•→‣▪_]+|[\s*|.:：。…!?？！>»›]+$")


def bare(line: str) -> str:
    """Lower case, without list marks and closing stops."""
    return BARE.sub("", line.strip().lower())


def entries(line: str) -> list[str]:
    """The entries of a menu line: short parts between separators; empty when the line is none."""
    if line.lstrip().startswith("|"):
        return []
    parts = [p for p in SEPARATOR.split(line.strip()) if p]
    if len(parts) < 2 or any(len(p) > 70 for p in parts) or sum(len(p) > 32 for p in parts) > 1 or END.search(parts[0]):
        return []
    return parts


@lru_cache(maxsize=200_000)
def furniture_kind(line: str) -> str | None:
    """The kind of page furniture that a line says it is, by its words alone."""
    if not line.strip():
        return None
    if TABLE.match(line):
        return None
    text = bare(line)
    if not text:
        return None
    if HEADING.match(line):
        return None
    size = len(text)
    for kind, pattern, most in PHRASE_PARTS:
        if size <= most and pattern.fullmatch(text):
            if kind == "paging" and not re.search(r"next|previous|prev|页|zurück|weiter|précédent|suivant|anterior|siguiente|page|seite|página", text):
                continue
            return kind
    if text in LEGAL:
        return "legal"
    if text in NAVIGATION:
        return "nav"
    parts = [bare(p) for p in entries(line)]
    if parts:
        if all(p in LEGAL or p in NAVIGATION for p in parts):
            return "legal" if any(p in LEGAL for p in parts) else "menu"
        known = sum(p in NAVIGATION for p in parts)
        if known >= 1 and known >= len(parts) - 1 and re.search(r"[>»›/]", line):
            return "crumbs"
        if known >= 2 and known * 2 >= len(parts):
            return "menu"
        kinds = [next((k for k, pat in PHRASE if pat.fullmatch(p)), None) for p in parts]
        if all(kinds) or (kinds[0] and sum(map(bool, kinds)) * 2 >= len(kinds)):
            return kinds[0]
    # a consent sentence with its buttons behind it on the line, or two sentences of a notice
    rest, first = line.strip(), None
    while rest:
        piece, rest = _first(rest)
        p = bare(piece)
        if p and not any(PHRASE_BY[k].fullmatch(p) for k in NOTICE) and not all(map(_is_button, filter(str.strip, _parts(p)))):
            return None
        first = p if first is None else first
    return next((k for k, pattern in PHRASE if k in NOTICE and k != "button" and pattern.fullmatch(first)), None)


NOTICE = ("consent", "button", "newsletter", "rating", "copyright", "share")
BREAK = re.compile(r"(?<=[.!?。])\s*|\s{2,}")
#: Further entries of the buttons of a notice.
ANSWERS = frozenset("learn more|read more|mehr erfahren|en savoir plus|más información|了解更多|yes|no|ja|nein|oui|non|sí|是|否|sign up|subscribe".split("|"))


def _first(text: str) -> tuple[str, str]:
    """The first sentence or part of a text, and what follows."""
    head, *rest = BREAK.split(text, maxsplit=1)
    return head, rest[0] if rest else ""


def _parts(piece: str) -> list[str]:
    """The entries of a row of buttons; without separators the last word stands alone."""
    if re.search(r"[|/·]|\s\s", piece):
        return re.split(r"\s*[|/·]\s*|\s{2,}|(?<=\S) (?=\S+$)", piece)
    return piece.rsplit(" ", 1)


def _is_button(entry: str) -> bool:
    text = bare(entry)
    return bool(text) and (PHRASE_BY["button"].fullmatch(text) is not None or text in ANSWERS)


PHRASE_BY = dict(PHRASE)


def shapes(lines: list[str]) -> list[str]:
    """For each line: blank, code, table, heading, item, prose or label (short, without a closing stop)."""
    out, inside = [], False
    for line in lines:
        if FENCE.match(line):
            inside = not inside
            out.append("code")
        elif inside:
            out.append("code")
        elif not line.strip():
            out.append("blank")
        elif TABLE.match(line):
            out.append("table")
        elif HEADING.match(line):
            out.append("heading")
        elif ITEM.match(line):
            out.append("item")
        elif END.search(line) or len(line) > (32 if CJK.search(line) else 90):
            out.append("prose")
        else:
            out.append("label")
    return out


def related_items(lines: list[str], shape: list[str]) -> dict[int, int]:
    """Position of each line of a list of related pages -> position of the list's heading."""
    owner: dict[int, int] = {}
    head = None
    for i, line in enumerate(lines):
        if shape[i] in ("blank", "code", "table", "heading", "prose"):
            head = None
            continue
        kind = furniture_kind(line)
        if kind == "related" and shape[i] == "label":
            head = i
        elif kind is not None:
            head = None
        elif head is not None:
            owner[i] = head
    return owner
