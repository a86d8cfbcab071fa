"""Forty pages of residue and forty honest ones, in many languages, written before the lists they are judged by."""

from pagewright.llm import markup, residue


def page(body, title="Notes"):
    return f"<html><head><title>{title}</title></head><body><nav><a href='/'>Home</a> <a href='/a'>About</a> <a href='/c'>Contact</a></nav>{body}<footer>© 2024 Example. All rights reserved.</footer></body></html>"


SENTENCES = (
    "The river crosses the old town in a wide bend before it reaches the mill.",
    "Most of the houses on its northern bank were built after the great fire of 1871.",
    "In summer the water is low enough to walk across on the stones.",
    "A small museum by the bridge shows tools that the ferrymen used for centuries.",
    "Visitors can take the path along the dam, which is open from April to October.",
    "It is said that the first bridge was paid for by a baker who had lost his hat in the flood.",
)


def prose(n=6):
    return "".join(f"<p>{SENTENCES[k % 6]} {SENTENCES[(k + 2) % 6]}</p>" for k in range(n))


RESIDUE = [
    "<center><h1>404 Not Found</h1></center><hr><center>nginx</center>",
    "<h1>Not Found</h1><p>The requested URL /a/b.html was not found on this server.</p><hr><address>Apache/2.4 Server at h.example Port 80</address>",
    "<h1>403 Forbidden</h1><p>You don't have permission to access /private on this server.</p>",
    "<h1>502 Bad Gateway</h1>",
    "<h1>Error 503 Backend fetch failed</h1><p>Backend fetch failed</p>",
    "<h2>Checking your browser before accessing h.example.</h2><p>This process is automatic. Your browser will redirect to your requested content shortly.</p>",
    "<p>Please verify you are a human. Access to this page has been denied because we believe you are using automation tools.</p>",
    "<p>Please turn JavaScript on and reload the page.</p>",
    "<noscript>You need to enable JavaScript to run this app.</noscript><div id=root></div>",
    "<b>Warning</b>: mysqli_connect(): (HY000/2002): Connection refused in <b>/var/www/html/db.php</b> on line <b>12</b>",
    "<p>Parse error: syntax error, unexpected end of file in /home/u/public_html/index.php on line 88</p>",
    "<pre>x</pre><p>Traceback (most recent call last): File app.py, line 3, in main NameError: name 'y' is not defined</p>",
    "<h1>Pagina non trovata</h1><p>La pagina che stai cercando non esiste o è stata spostata.</p>",
    "<h1>Accesso negato</h1><p>Non hai i permessi per visualizzare questa pagina.</p>",
    "<h1>Página não encontrada</h1><p>Desculpe, a página que você procura não existe.</p>",
    "<p>Por favor, ative o JavaScript no seu navegador para continuar.</p>",
    "<h1>Страница не найдена</h1><p>Запрашиваемая страница не существует.</p>",
    "<p>Для работы сайта необходимо включить JavaScript.</p>",
    "<h1>ページが見つかりません</h1><p>お探しのページは見つかりませんでした。</p>",
    "<p>このサイトを利用するには、JavaScriptを有効にしてください。</p>",
    "<h1>页面不存在</h1><p>抱歉，您访问的页面不存在。</p>",
    "<h1>Pagina niet gevonden</h1><p>De pagina die u zoekt bestaat niet meer.</p>",
    "<h1>Nie znaleziono strony</h1><p>Strona, której szukasz, nie istnieje.</p>",
    "<h1>Seite nicht gefunden</h1><p>Die von Ihnen aufgerufene Seite existiert leider nicht.</p>",
    "<p>Bitte aktivieren Sie JavaScript in Ihrem Browser, um diese Seite zu nutzen.</p>",
    "<h1>Page introuvable</h1><p>La page que vous recherchez n’existe pas ou a été déplacée.</p>",
    "<p>Veuillez activer JavaScript dans votre navigateur pour continuer.</p>",
    "<h1>Error 500</h1><p>Ha ocurrido un error interno del servidor. Inténtelo más tarde.</p>",
    "<p>We'll be back soon! Sorry for the inconvenience but we're performing some maintenance at the moment.</p>",
    "<p>Your session has timed out. Please log in again to continue.</p>",
    prose(3) + "<p>Dear {{ customer.first_name }}, your order {{ order_id }} is on its way.</p>",
    prose(2) + "<h2>{{page_title}}</h2><p>Written by {{author}}</p>",
    prose(2) + "<p>Welcome to %%COMPANY_NAME%%, open daily from %%OPENING_HOURS%%.</p>",
    prose(2) + "<p>Posted on <%= post.date %> by <%= post.author %></p>",
    prose(2) + "<p>[Insert your text here]</p>",
    "<h1>Lorem ipsum dolor</h1><p>Lorem ipsum dolor sit amet, consectetur adipiscing elit. Pellentesque habitant morbi tristique senectus et netus et malesuada fames ac turpis egestas.</p>",
    prose(2) + "<p>Sed ut perspiciatis unde omnis iste natus error sit voluptatem accusantium doloremque laudantium, totam rem aperiam eaque ipsa.</p>",
    prose(1) + "<p>Weit hinten, hinter den Wortbergen, fern der Länder Vokalien und Konsonantien leben die Blindtexte.</p>",
    "<p>This is a placeholder. Replace this text with your own content.</p>",
    "<p>Content coming soon.</p>",
]
HONEST = [
    prose(6),
    prose(15) + "<p>In French one says «oui», and in Spanish «sí», wherever English has a plain yes.</p>",
    prose(15) + "<p>For a small angle $alpha$ the sine is close to $alpha$ itself, as the figure shows.</p>",
    prose(15) + "<p>Let {x} be the set that holds x only; then {x} has one element and the power set of {x} has two.</p>",
    prose(15) + "<p>The agency [NASA] and its partner [ESA] have planned the mission since 2009.</p>",
    prose(15) + "<p>The hook __INIT_SUBCLASS__ is called whenever a class is derived from another one.</p>",
    prose(15) + "<p>Set ${HOME} before you start the tool, otherwise it writes its files to the current folder.</p>",
    prose(4) + "<pre>Hello {{ name }}, welcome to <%= site %></pre>",
    prose(3) + "<p>A template engine replaces <code>{{ name }}</code> by the value of the variable, which may be empty.</p>",
    "<h1>What a 404 error means</h1>" + prose(3) + "<p>A server answers with the status 404 if it has no page under the address that the reader asked for. " + SENTENCES[0] + "</p>",
    "<h1>How to enable JavaScript</h1><p>Some sites ask you to enable JavaScript, and many readers wonder how that is done. In most browsers the switch stands in the settings under privacy, and it takes effect when the page is loaded again.</p>" + prose(3),
    prose(5) + "<noscript>Please enable JavaScript to use the comment form.</noscript>",
    prose(5) + "<p>Access to the tower was denied to visitors until 1950, when the stairs had been repaired.</p>",
    prose(5) + "<p>The library is closed for maintenance in the first week of August, as it is each year.</p>",
    prose(5) + "<p>The printers of the sixteenth century scrambled a text of Cicero, and it has been used as filler ever since, mostly from the words lorem and ipsum onwards.</p>",
    "<h1>De finibus</h1><p>Gallia est omnis divisa in partes tres, quarum unam incolunt Belgae, aliam Aquitani, tertiam qui ipsorum lingua Celtae, nostra Galli appellantur.</p>" + prose(4),
    "<h1>Horaires</h1><p>La bibliothèque est ouverte du lundi au vendredi de neuf heures à dix-huit heures, et le samedi matin pendant les vacances scolaires.</p>" + prose(2),
    "<h1>Orario</h1><p>Il museo è aperto tutti i giorni tranne il lunedì, dalle dieci alle diciotto; la domenica l’ingresso è gratuito per chi abita in città.</p>",
    "<h1>Horario</h1><p>La oficina atiende de lunes a viernes por la mañana; en agosto permanece cerrada y no se contesta el correo.</p>",
    "<h1>Öffnungszeiten</h1><p>Das Archiv ist von Montag bis Donnerstag geöffnet; wer Akten einsehen will, meldet sich bitte einen Tag vorher an.</p>",
    "<p>Музей открыт каждый день, кроме понедельника. Билеты продаются в кассе у входа, дети до семи лет проходят бесплатно.</p>",
    "<p>図書館は月曜日から金曜日まで開いています。土曜日は午前中だけ利用できます。</p>",
    "<p>博物馆每天开放，周一除外。门票可以在入口处购买，七岁以下儿童免费。</p>",
    "<ul><li>Bread and butter</li><li>Milk of the day</li><li>Apples from the garden</li><li>Honey</li></ul>" + prose(1),
    "<table><tr><td>Monday</td><td>9:00</td><td>Room 4</td></tr><tr><td>Tuesday</td><td>11:00</td><td>Room 7</td></tr></table>" + prose(1),
    "<h1>Test results</h1>" + "".join(f"<p>Test {k} of the pump was passed after {k * 7} minutes without a leak.</p>" for k in range(1, 8)),
    prose(3) + "<p>TODO lists are older than computers: merchants wrote them on wax tablets, and nobody knows who was the first.</p>",
    prose(3) + "<p>Replies arrived from all members [see note 3], and the committee [then still of five] met in May.</p>",
    prose(3) + "<p>The price is $5 to $7 a pound, and about 40 % of it goes to the growers; 5% is kept for repairs, 3% for the fund.</p>",
    prose(3) + "<p>In C the expression a %d b has no meaning, but a % b gives the rest of a division.</p>",
    prose(3) + "<p>Write {a, b} for the pair of a and b, and {{a}, {a, b}} for the ordered one, as Kuratowski did.</p>",
    prose(3) + "<p>The album «Tempus» and the song «Lux» were recorded in a chapel; critics liked the latter more.</p>",
    prose(3) + "<h2>The page that was not found</h2><p>A leaf of the manuscript has been missing since 1820, and the search for it fills a chapter of its own.</p>",
    prose(3) + "<p>The session ended at noon, and everybody had to sign in again after lunch, which took the clerks an hour.</p>",
    prose(3) + "<p>An error of one inch in the plan went unnoticed until the roof was on, and it could not be mended any more.</p>",
    prose(3) + "<p>Server rooms were unavailable in the old building, so the service moved to the cellar of the mill.</p>",
    prose(3) + "<p>Magna Carta, sed lex: the motto on the wall is bad Latin, but it has amused the students for years.</p>",
    "<h1>Script lessons</h1><p>The course requires scripts to be read aloud; actors who need more time may turn the pages on their own.</p>" + prose(2),
    "<h1>Coming soon to the cinema</h1>" + prose(4),
    "<h1>Forbidden fruit</h1>" + prose(4),
]


def test_held_out_pages():
    machine = residue.automaton()
    judged = lambda body: residue.judge(markup.blocks(page(body)), machine).residue
    hits, alarms = [judged(b) for b in RESIDUE], [judged(b) for b in HONEST]
    assert len(hits) == len(alarms) == 40
    missed, wrong = [b[:90] for b, h in zip(RESIDUE, hits, strict=True) if not h], [b[-160:] for b, a in zip(HONEST, alarms, strict=True) if a]
    assert sum(hits) >= 36 and sum(hits) / max(1, sum(hits) + sum(alarms)) >= 0.9, (missed, wrong)
