"""Fixed word lists of the page detectors, in plain text and natural order."""

from __future__ import annotations

# Frequent function words of English, German, French, Spanish, Italian, Portuguese, Dutch, Polish and Russian.
FUNCTION_WORDS = frozenset(
    """
    the of a an and or in is are was were be been that this these those for to with without as on by from at it its
    their our his her your my which who what when where while because although since than more most any some each every
    another other one same not no if then there here has have had will would can could should may but so such whereas
    der die das den dem des ein eine einer eines einem einen und oder im in ins am an auf aus bei bis mit nach seit von vom
    vor zu zum zur für über unter um ohne durch gegen trotz während ist sind war nicht auch aber doch denn sondern sich als
    le la les l un une des du de d et ou en dans au aux sur sous pour par avec sans que qui ne pas est sont se ce cette car
    mais tandis alors pendant depuis avant après contre plus
    el los las lo una unos unas del al y o con por para sin sobre entre desde hasta que se su sus es son no pero porque
    mientras aunque durante antes
    il lo gli di del della dei delle nel nella che non è sono ed alla dal con per più anche come tra fra
    os as um uma do da dos das em no na nos nas ao à não mais mas ou pelo pela é são foi
    het een van en op te dat niet met voor zijn naar ook maar bij uit aan
    nie się że jest na do ze jak od za przez po dla są oraz ale lub
    и в не на я что с по к у из за от для это как его но или а о же до при так все
    """.split()
)

# Vocabulary of the standard filler text, of the passage of Cicero it was made from, and of common
# generators; words that are frequent in living languages are left out.
FILLER_WORDS = frozenset(
    """
    lorem ipsum dolor sit amet consectetur consectetuer consetetur adipiscing adipisicing sadipscing elit elitr sed eiusmod
    eirmod nonumy nonummy tempor incididunt invidunt labore dolore dolores magna aliqua aliquam aliquyam aliquet aliquid enim
    minim veniam quis quisque nostrud nostrum exercitation ullamco ullamcorper laboris nisi nisl aliquip commodo consequat duis
    aute irure iriure reprehenderit voluptate voluptas voluptatem voluptua velit esse cillum fugiat fugit feugiat feugait
    pariatur excepteur sint occaecat occaecati cupidatat cupiditate proident sunt culpa officia deserunt deserunt mollit mollitia
    anim laborum perspiciatis omnis iste natus accusantium accusamus accusam doloremque laudantium totam aperiam eaque ipsa
    inventore veritatis quasi architecto beatae vitae dicta explicabo nemo ipsam quia aspernatur odit consequuntur eos ratione
    sequi nesciunt neque porro quisquam dolorem dolorum modi tempora incidunt magnam quaerat eius dignissimos ducimus blanditiis
    praesentium deleniti atque corrupti quos molestias molestie excepturi similique harum quidem rerum facilis facilisi facilisis
    expedita distinctio libero soluta nobis eligendi optio cumque nihil impedit minus placeat facere possimus assumenda
    repellendus temporibus autem quibusdam officiis debitis necessitatibus saepe eveniet voluptates repudiandae recusandae itaque
    earum hic tenetur sapiente delectus reiciendis voluptatibus maiores perferendis doloribus asperiores repellat
    diam nibh euismod tincidunt laoreet erat volutpat wisi exerci tation suscipit lobortis vel eum hendrerit vulputate illum eros
    accumsan iusto odio dignissim praesent luptatum zzril delenit augue stet clita kasd gubergren takimata sanctus rebum
    aenean aptent arcu auctor bibendum blandit condimentum congue conubia convallis cras cubilia curabitur curae cursus dapibus
    dictum dictumst donec dui efficitur egestas eget eleifend elementum etiam fames faucibus felis fermentum finibus fringilla
    fusce gravida habitant habitasse himenaeos iaculis imperdiet inceptos integer interdum justo lacinia lacus lectus leo ligula
    litora luctus maecenas malesuada massa mattis mauris maximus metus mi montes morbi nascetur natoque nec netus non nostra
    nulla nullam nunc orci ornare parturient pellentesque penatibus per pharetra phasellus platea porta porttitor posuere potenti
    pretium primis proin pulvinar purus quam rhoncus ridiculus risus rutrum sagittis sapien scelerisque semper senectus sociosqu
    sodales sollicitudin suspendisse taciti tellus tempus torquent tortor tristique turpis ultrices ultricies urna ut varius
    vehicula venenatis vestibulum vivamus viverra volutpat ante
    """.split()
) - frozenset("sit non per ut nec vel hic mi leo minus quam quasi quia sunt atque omnis facilis modi".split())

# Those of them that also stand alone in ordinary text of some living language.
ORDINARY_FILLER = frozenset("ante auctor culpa dictum dolor dolores integer justo libero magna massa nulla porta primis semper tempus urna varius velit".split())

# Function words of Latin, which filler has like any Latin text.
LATIN_FUNCTION_WORDS = frozenset("a ab ac ad at aut cum de e ea est et ex id in nec non per pro qui quo se sed si tu ut vel".split())

# What people type where a text will stand: metasyntactic names and runs along the keyboard.
TYPED_FILLER = frozenset("abc asd asdf asdfg bar baz bla blabla blah dummy foo foobar hjkl jkl qux qwe qwer qwert qwerty qwertz sdf test testing testtest uiop xxx xxxx yxcv zxcv".split())

# Openings of filler passages that are not Latin-like or stand in other languages.
FILLER_PHRASES = (
    "lorem ipsum dolor sit", "sed ut perspiciatis unde omnis", "at vero eos et accusam", "far far away, behind the word mountains",
    "weit hinten, hinter den wortbergen", "li europan lingues es membres", "quick brown fox jumps over the lazy dog",
    "überall dieselbe alte leier", "dies ist ein typoblindtext", "лорем ипсум", "рыбный текст", "ダミーテキスト", "サンプルテキスト", "乱数假文",
)

# Messages that stand where a page's own text should be, by language. White space and case do
# not matter; "#" stands for a run of digits.
ERROR_MESSAGES = (
    # English, servers and programs
    "error #", "http #", "# error", "# not found", "# forbidden", "# bad gateway", "# unauthorized", "page not found", "file not found", "not found",
    "was not found", "could not be found", "could not find", "couldn't find", "can't find", "cannot find", "cannot be found", "page you requested", "page you asked for", "page you are looking for",
    "page you were looking for", "requested url", "requested page", "is not here", "does not exist", "doesn't exist", "no longer exists", "no longer available", "has been moved or deleted",
    "has been removed", "internal server error", "server error", "something went wrong", "an error occurred", "an error has occurred", "unexpected error",
    "application error", "backend fetch failed", "fatal error", "parse error", "syntax error", "uncaught exception", "unhandled exception", "undefined function", "undefined variable", "undefined index",
    "stack trace", "traceback (most recent call last)", "nullpointerexception", "on line #", "database connection", "error establishing a database connection",
    "connection refused", "connection timed out", "connection reset", "could not be established", "could not connect", "gateway timeout", "gateway time-out", "bad gateway",
    "bad request", "service unavailable", "temporarily unavailable", "request timed out", "timed out", "while waiting for", "too many requests", "rate limit exceeded", "try again in #", "try again later",
    "please try again", "access denied", "access is denied", "access to this page has been denied", "you have been blocked", "you are not allowed to", "you do not have permission", "you don't have permission",
    "not authorized", "permission denied", "forbidden", "unauthorized", "verify you are a human", "verify you are human", "verify that you are not a robot", "checking your browser", "security check",
    "this process is automatic", "your browser will redirect", "unusual traffic", "attention required", "session has expired", "session expired", "session has timed out", "session timed out",
    "session is no longer valid", "please sign in", "please log in", "sign in again", "log in again", "must be logged in", "down for maintenance", "under maintenance", "scheduled maintenance", "performing some maintenance",
    "undergoing maintenance", "the service is down", "be back soon", "be right back",
    # German
    "fehler #", "nicht gefunden", "wurde nicht gefunden", "existiert nicht", "existiert leider nicht", "nicht mehr verfügbar", "interner serverfehler", "serverfehler", "ein fehler ist aufgetreten", "etwas ist schiefgelaufen",
    "zugriff verweigert", "zugriff auf", "verweigert", "keine berechtigung", "nicht berechtigt", "sitzung ist abgelaufen", "sitzung abgelaufen", "erneut an", "melden sie sich", "wegen wartung", "wartungsarbeiten", "wartungsmodus",
    "nicht erreichbar", "nicht verfügbar", "versuchen sie es später", "später erneut", "zu viele anfragen",
    # French
    "erreur #", "introuvable", "est introuvable", "n’existe pas", "n'existe pas", "n’a pas été trouvée", "n'a pas été trouvée", "erreur interne", "erreur du serveur", "une erreur est survenue", "une erreur s’est produite", "une erreur s'est produite",
    "accès refusé", "accès interdit", "accès non autorisé", "session a expiré", "session expirée", "reconnecter", "en maintenance", "maintenance en cours", "service indisponible", "indisponible", "veuillez réessayer", "trop de requêtes",
    # Spanish
    "no se encontró", "no se ha encontrado", "no encontrada", "no encontrado", "no existe", "ya no existe", "error interno", "error del servidor", "se ha producido un error", "ha ocurrido un error", "acceso denegado", "acceso prohibido", "no tiene permiso",
    "sesión ha caducado", "sesión ha expirado", "sesión caducada", "inicie sesión", "en mantenimiento", "servicio no disponible", "no disponible", "demasiadas solicitudes", "inténtelo", "inténtalo",
    # Italian, Portuguese
    "errore #", "pagina non trovata", "non è stata trovata", "non trovata", "non esiste", "è stata spostata", "si è verificato un errore", "accesso negato", "non hai i permessi", "sessione scaduta", "in manutenzione", "servizio non disponibile", "riprova più tardi",
    "erro #", "página não encontrada", "não foi encontrada", "não encontrada", "não existe", "ocorreu um erro", "erro interno", "acesso negado", "sessão expirou", "em manutenção", "serviço indisponível", "tente novamente",
    # Dutch, Polish, Swedish, Turkish
    "fout #", "niet gevonden", "bestaat niet", "er is een fout opgetreden", "toegang geweigerd", "sessie is verlopen", "in onderhoud", "probeer het later",
    "nie znaleziono", "nie istnieje", "wystąpił błąd", "błąd #", "brak dostępu", "odmowa dostępu", "sesja wygasła", "przerwa techniczna", "spróbuj ponownie",
    "sidan hittades inte", "sidan finns inte", "ett fel uppstod", "åtkomst nekad", "sayfa bulunamadı", "bir hata oluştu", "erişim engellendi",
    # Russian, Japanese, Chinese, Korean
    "ошибка #", "страница не найдена", "не найдена", "не существует", "произошла ошибка", "доступ запрещен", "доступ запрещён", "сессия истекла", "технические работы", "попробуйте позже",
    "見つかりません", "存在しません", "エラーが発生しました", "アクセスが拒否", "アクセス権がありません", "セッションが切れ", "メンテナンス中",
    "页面不存在", "找不到", "未找到", "页面未找到", "不存在", "访问被拒绝", "没有权限", "服务器错误", "系统维护", "会话已过期", "頁面不存在",
    "페이지를 찾을 수 없습니다", "오류가 발생했습니다", "접근이 거부",
)

# Names of scripts, and words by which a sentence demands them or says that they are off.
SCRIPT_WORDS = ("javascript", "java script", "scripts", "scripting", "skripte", "skripten", "les scripts", "los scripts", "gli script", "скрипты")
SCRIPT_DEMANDS = (
    "enable", "enabled", "turn on", "turn them on", "switch on", "activate", "allow", "require", "requires", "required", "need", "needs", "disabled", "turned off", "switched off", "blocked", "blocking", "does not support", "without",
    "on and reload", "please turn", "aktivieren", "aktiviert", "einschalten", "erlauben", "benötigt", "erforderlich", "deaktiviert", "zulassen", "activer", "activez", "autoriser", "autorisez", "besoin de", "nécessite", "désactivé", "requis",
    "activar", "active", "habilitar", "habilite", "permitir", "permita", "necesita", "requiere", "desactivado", "abilitare", "abilita", "attivare", "attiva", "richiede", "necessario", "ative", "ativar", "habilite", "precisa", "requer", "desativado",
    "inschakelen", "schakel", "nodig", "vereist", "włącz", "włączyć", "wymaga", "wyłączony", "включить", "включите", "необходимо", "требуется", "отключен", "有効", "必要", "無効", "启用", "開啟", "需要", "禁用",
)

#: What scripts are demanded for or of, which tells scripts of a browser from those of a play.
SCRIPT_PLACES = (
    "browser", "your browser", "reload", "page", "site", "website", "app", "application", "device", "settings", "continue", "this service", "to view", "to see", "to use", "to display", "pour afficher", "pour voir", "para ver", "per visualizzare", "seite", "website", "anwendung", "einstellungen", "navigateur", "site", "application",
    "navegador", "sitio", "página", "aplicación", "sito", "applicazione", "pagina", "przeglądarce", "strona", "браузере", "сайта", "ブラウザ", "浏览器",
)
#: Parts of a page that may need scripts while its text does not.
WIDGETS = (
    "search box", "search field", "search form", "comment form", "comments", "map", "menu", "gallery", "slideshow", "video", "player", "calendar widget", "chart", "sidebar", "suchfeld", "karte", "kommentare", "seitenleiste", "galerie",
    "champ de recherche", "zone de recherche", "carte", "commentaires", "barre latérale", "buscador", "cuadro de búsqueda", "mapa", "comentarios", "barra lateral", "casella di ricerca", "mappa", "commenti",
)

# What is missing in a note on text that is still to be written, and the states it can be in.
NOTE_SUBJECTS = frozenset(
    """
    text copy content contents intro introduction picture pictures image images photo photos photograph quote quotation caption headline heading
    title description body paragraph section chapter summary abstract details bio biography chart figure table video logo link article page address
    bild foto einleitung zitat beschreibung inhalt überschrift absatz texte image citation contenu titre légende texto imagen foto
    introducción cita contenido descripción título testo immagine contenuto descrizione titolo imagem conteúdo descrição tekst afbeelding inhoud
    """.split()
)
NOTE_STATES = (
    "goes here", "go here", "to follow", "still missing", "is missing", "to be supplied", "to be replaced", "to be added", "to be written", "to be provided", "to be confirmed", "to be completed",
    "to come", "coming soon", "your own", "tbd", "tba", "tbc", "folgt", "folgt noch", "fehlt noch", "fehlt", "noch zu ergänzen", "zu ergänzen", "wird ergänzt", "wird nachgereicht", "kommt noch", "zu ersetzen",
    "à venir", "à compléter", "à remplacer", "à rédiger", "à ajouter", "à fournir", "manque encore", "manque", "provisoire", "por completar", "por añadir", "por redactar", "pendiente", "falta", "falta todavía", "de ejemplo", "de muestra", "próximamente",
    "da completare", "da inserire", "in arrivo", "em breve", "a completar", "de exemplo", "volgt", "ontbreekt nog", "binnenkort", "скоро будет", "準備中", "即将推出",
)
#: Notes by themselves, and marks that open one.
FILLER_NOTES = (
    "sample text", "dummy text", "placeholder", "placeholder text", "replace this text", "text goes here", "your text here", "insert your text", "coming soon", "under construction",
    "platzhalter", "beispieltext", "blindtext", "hier entsteht", "text folgt", "texte à venir", "texte provisoire", "faux texte", "en construction", "texto de ejemplo", "texto de muestra", "en construcción",
    "testo segnaposto", "in costruzione", "texto de exemplo", "em construção", "voorbeeldtekst", "in aanbouw", "tekst zastępczy", "w budowie", "в разработке", "工事中", "建设中",
)
NOTE_MARKS = ("todo", "tbd", "tba", "tbc", "fixme", "xxx")

# Names that fields of templates have, whole or in parts.
FIELD_NAMES = frozenset(
    """
    address amount author authors body category city code company content copyright count country course customer date day deadline department description
    email event excerpt field first footer full header heading headline hours id image intro item key label last link location logo message month name
    number order page parent phone place post price product quantity recipient room sender site slug speaker state status street subject subtitle summary
    tag text time title total unit url user username value venue website week year zip
    anrede betreff datum name nachname ort preis strasse titel vorname adresse auteur lieu nom objet prénom prix titre
    asunto autor ciudad fecha lugar nombre precio título
    """.split()
)
# Words of sentences that have slots for their subject.
SLOT_SUBJECTS = frozenset(
    """
    template templates templating placeholder placeholders variable variables syntax macro macros expression expressions slot slots escape escaped braces brackets
    platzhalter vorlage vorlagen variablen syntax klammern gabarit gabarits accolades syntaxe plantilla plantillas variables llaves sintaxis segnaposto modello
    """.split()
)

# The openers of template slots that the automaton looks for.
SLOT_OPENERS = ("{", "%%", "%(", "<%", "«", "@@", "__", "[", "$")
