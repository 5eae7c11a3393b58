"""Neutral examples that the residue models start from; fixed values, written from general knowledge, one per line.

They only start the models: what residue of a corpus looks like is learned from the corpus itself (self-training in
``residue.fit``). None of them is taken from the test tables; a test asserts that none stands in them.
"""

FILLER = """
Pellentesque habitant morbi tristique senectus et netus et malesuada fames ac turpis egestas.
Vestibulum tortor quam, feugiat vitae, ultricies eget, tempor sit amet, ante.
Donec eu libero sit amet quam egestas semper. Aenean ultricies mi vitae est.
Quisque sit amet est et sapien ullamcorper pharetra. Mauris placerat eleifend leo.
Aenean fermentum, elit eget tincidunt condimentum, eros ipsum rutrum orci, sagittis tempus lacus enim ac dui.
Praesent dapibus, neque id cursus faucibus, tortor neque egestas augue, eu vulputate magna eros eu erat.
Nam dui mi, tincidunt quis, accumsan porttitor, facilisis luctus, metus.
Curabitur pretium tincidunt lacus. Nulla gravida orci a odio, nec luctus magna felis sollicitudin mauris.
Nullam varius, turpis et commodo pharetra, est eros bibendum elit. Integer in mauris eu nibh euismod gravida.
Ut ullamcorper, ligula eu tempor congue, eros est euismod turpis, id tincidunt sapien risus a quam.
Maecenas fermentum consequat mi. Donec fermentum. Duis sapien sem, aliquet nec, commodo eget, consequat quis, neque.
Aliquam faucibus, elit ut dictum aliquet, felis nisl adipiscing sapien, sed malesuada diam lacus eget erat.
Curabitur augue lorem, dapibus quis, laoreet et, pretium ac, nisi. Etiam porta viverra velit, labore et dolore magna.
Sed ut perspiciatis unde omnis iste natus error sit voluptatem accusantium doloremque laudantium, totam rem aperiam.
Nemo enim ipsam voluptatem quia voluptas sit aspernatur aut odit aut fugit, sed quia consequuntur magni dolores.
Neque porro quisquam est qui dolorem ipsum quia dolor sit amet consectetur adipisci velit.
At vero eos et accusam et justo duo dolores et ea rebum, stet clita kasd gubergren.
lorem ipsum dolor lorem ipsum dolor lorem ipsum
asdfgh asdfgh asdfgh jklm jklm qwertz qwertz
asdf asdf jkl jkl qwer qwer asdf asdf zxcv
qwerty asdf zxcv qwerty asdf zxcv
aaaa aaaa bbbb bbbb cccc cccc
xxx xxx xxx yyy yyy zzz zzz
yada yada yada blah blah blah
foo bar baz qux foo bar baz qux
test text test text sample sample sample text text
This is a dummy paragraph that only fills the page layout.
This block holds placeholder copy and has to be replaced before launch.
Placeholder headline: your own headline goes here.
Your own words go here, replace me.
Insert a short description of the product here.
Type your own message here.
Enter a short summary here.
Add some text for this section here.
Put a few words about yourself here.
Write your story here.
Replace these lines with your own copy.
Dummy content, please replace before publishing.
Sample copy used until the final text is delivered.
Mock content for the design, not the final copy.
Filler sentences for the mockup, to be replaced later.
[draft: text to be added]
[nothing here yet, fill in later]
(this section is empty)
(description missing)
Image caption goes here.
The headline goes here. The second line goes here.
Description to be added later.
This page is coming soon, stay tuned.
More details will follow soon.
Content is pending and will be announced.
Text to be decided. Wording to be confirmed.
No summary has been written yet.
No content has been added yet.
Este párrafo es un texto simulado que solo sirve para la maqueta.
Texto de muestra que debe sustituirse por el contenido final.
Escriba aquí una breve descripción. Inserte aquí su mensaje.
Sustituya este texto por el suyo. Su título va aquí.
Este es un párrafo de relleno sin significado. Aquí va la descripción.
Próximamente habrá contenido en esta sección.
Este parágrafo é um texto fictício que só serve para o leiaute.
Texto de exemplo que deve ser trocado pelo conteúdo final.
Escreva aqui uma breve descrição. Insira aqui a sua mensagem.
Substitua este texto pelo seu. O seu título vai aqui.
Em breve haverá conteúdo nesta seção.
Ce paragraphe est un texte fictif qui ne sert qu'à la mise en page.
Texte d'exemple à remplacer par le contenu définitif.
Saisissez ici une courte description. Insérez ici votre message.
Remplacez ce texte par le vôtre. Votre titre vient ici.
Le contenu de cette section viendra bientôt.
Dieser Absatz ist ein Blindtext und füllt nur das Layout.
Mustertext, der noch durch den endgültigen Inhalt ersetzt wird.
Geben Sie hier eine kurze Beschreibung ein. Fügen Sie hier Ihre Nachricht ein.
Ersetzen Sie diesen Text durch Ihren eigenen. Hier steht Ihre Überschrift.
Der Inhalt dieses Abschnitts folgt in Kürze. Platzhalter für eine Überschrift.
Этот абзац является текстом-рыбой и только заполняет макет страницы.
Пример текста, который нужно заменить окончательным содержанием.
Введите здесь краткое описание. Вставьте сюда ваше сообщение.
Замените этот текст своим. Здесь будет ваш заголовок.
Содержание этого раздела скоро появится.
이 단락은 화면 배치를 위한 더미 문장입니다.
최종 내용으로 바꾸어야 하는 예시 문구입니다.
제목과 내용을 입력하세요.
이 예시용 문단에는 더미 텍스트가 들어 있습니다.
여기에 간단한 설명을 입력해 주세요. 여기에 메시지를 넣으세요.
이 글을 직접 쓴 내용으로 바꾸세요. 여기에 제목이 들어갑니다.
이 항목의 내용은 곧 준비될 예정입니다.
この段落はレイアウト用のダミー文章です。
最終的な内容に差し替えるためのサンプル文章です。
ここに短い説明を入力してください。ここにメッセージを書いてください。
この文章をご自分の文章に置き換えてください。ここに見出しが入ります。
この欄の内容は近日公開予定です。
"""

NOTICE = """
JavaScript has to be switched on in order to use this website.
Please enable JavaScript in your browser settings and reload this site.
Please turn on scripts in your web browser, then refresh.
It looks like JavaScript is turned off or blocked in your web browser.
You have JavaScript disabled. Scripting is disabled on your device.
Your web browser does not support scripts or has them blocked.
This website requires JavaScript and cookies to be enabled.
This web application needs client-side scripting to run.
The application relies on JS and will not work without it.
The viewer cannot start without scripts, kindly allow them.
Make sure that JavaScript and cookies are activated, then try to load the page again.
You must allow scripting to see this content.
Without JavaScript some parts of the website may not work correctly.
Para usar este sitio debe activar JavaScript en su navegador.
JavaScript está deshabilitado o bloqueado. Esta aplicación necesita JavaScript.
Habilite los scripts y vuelva a cargar el sitio.
Para usar este site é necessário ativar o JavaScript no navegador.
O JavaScript está bloqueado ou desabilitado. Este aplicativo precisa de JavaScript.
Habilite os scripts e recarregue o site.
Pour utiliser ce site, vous devez activer JavaScript dans votre navigateur.
JavaScript est bloqué ou désactivé. Cette application a besoin de JavaScript.
Veuillez autoriser les scripts puis recharger le site.
Um diese Website zu nutzen, müssen Sie JavaScript im Browser aktivieren.
JavaScript ist ausgeschaltet oder gesperrt. Diese Anwendung benötigt JavaScript.
Bitte erlauben Sie Skripte und laden Sie die Website neu. Für diese Website muss JavaScript aktiviert sein.
Чтобы пользоваться сайтом, включите JavaScript в браузере.
JavaScript отключен или заблокирован. Этому приложению нужен JavaScript.
Разрешите скрипты и обновите страницу. Для этого сайта нужны скрипты.
이 사이트를 이용하려면 브라우저에서 JavaScript를 켜야 합니다.
JavaScript가 차단되었거나 꺼져 있어요. 이 앱에는 JavaScript가 필요합니다.
이 사이트를 보려면 스크립트를 허용해야 해요.
스크립트를 허용하고 페이지를 새로 고쳐 주세요.
このサイトを利用するにはブラウザの JavaScript を有効にする必要があります。
JavaScript がブロックされているか無効です。このアプリには JavaScript が必要です。
スクリプトを許可してページを再読み込みしてください。
HTTP 404: the page could not be found
HTTP/1.1 404 File not found
404 error: document not found on this server
We are sorry, but the page that you were looking for could not be found.
The resource you requested does not exist, was moved or has been removed.
The file you want is no longer available. This address does not exist.
HTTP 403: access to this resource is forbidden
403 error: permission denied, access denied to the requested page
You do not have permission to access this resource. You are not allowed to open this document.
HTTP 401: authorization required, please sign in
Your session has timed out, please sign in again to continue.
This content is private or was removed by its owner, video is unavailable.
This video is not available in your country or region.
HTTP 429: too many requests were sent, slow down
You have sent too many requests in a given amount of time, please wait.
HTTP 500: internal server error has occurred
500 error: the server encountered an internal error and was unable to complete your request
Sorry, something went wrong on the server. Oops, an unexpected error occurred.
Whoops, this document is gone. Hmm, we could not load that document.
HTTP 502: bad gateway, received an invalid response from the upstream server
502 proxy error: bad gateway
HTTP 503: the service is temporarily unavailable
503 error: service temporarily unavailable, the site is down for scheduled maintenance
HTTP 504: gateway time-out, the upstream server did not respond in time
504 error: the gateway timed out
The connection has timed out. The connection was reset. The connection was refused by the server.
The operation timed out after 20 seconds. The upload has failed after 3 s.
The request was aborted after 8 s. The download was refused or interrupted after 9 s.
Please try again in a few minutes. Please contact the site administrator.
Your IP address has been blocked or suspended. Your account has been restricted. Request ID 4f1c09ab7d
Fatal error: the stream was closed unexpectedly (code 12)
Fatal exception: invalid or expired token (code 7)
Fatal: the database is not reachable, connection quota was exceeded (code 3)
net::ERR_INTERNET_DISCONNECTED
ERR_ADDRESS_UNREACHABLE
net::ERR_CONNECTION_CLOSED
ERR_SSL_PROTOCOL_ERROR
ERR_TOO_MANY_REDIRECTS
<html><head><title>Error page</title></head><body>web server/1.0</body></html>
<title>Service error</title> server/1.2
{"error": {"status": 418, "message": "request was rejected"}}
{"status": "error", "code": 400, "message": "bad request"}
HTTP 404: no se pudo encontrar la página
La página que busca no existe o ha sido eliminada. Error 404, página no encontrada en este servidor.
HTTP 403: acceso denegado a este recurso. No dispone de permiso para acceder a este contenido.
HTTP 500: se produjo un error interno en el servidor. Algo ha fallado, vuelva a intentarlo más tarde.
HTTP 503: el servicio no está disponible en este momento. Este vídeo ya no está disponible.
HTTP 404: não foi possível encontrar a página
A página que procura não existe ou foi removida. Erro 404, página não encontrada neste servidor.
HTTP 403: acesso negado a este recurso. Não tem permissão para acessar este conteúdo.
HTTP 500: ocorreu um erro interno no servidor. Algo deu errado, tente novamente mais tarde.
HTTP 503: o serviço está indisponível neste momento. Este vídeo não está mais disponível.
HTTP 404 : impossible de trouver la page
La page que vous cherchez n'existe pas ou a été supprimée. Erreur 404, page introuvable sur ce serveur.
HTTP 403 : accès refusé à cette ressource. Vous n'avez pas l'autorisation d'accéder à ce contenu.
Vous n'avez pas le droit d'ouvrir ce document. La page demandée n'est plus là.
HTTP 500 : une erreur interne du serveur est survenue. Un problème est survenu, merci de réessayer plus tard.
HTTP 503 : le service est indisponible pour le moment. Cette vidéo n'est plus disponible.
HTTP 404: die Seite konnte nicht gefunden werden
Die gesuchte Seite existiert nicht oder wurde entfernt. Fehler 404, Seite nicht gefunden auf diesem Server.
HTTP 403: Zugriff auf diese Ressource verweigert. Sie haben keine Berechtigung, diesen Inhalt anzusehen.
HTTP 500: ein interner Serverfehler ist aufgetreten. Etwas ist schiefgelaufen, versuchen Sie es später noch einmal.
HTTP 503: der Dienst ist zurzeit nicht verfügbar. Dieses Video ist nicht mehr verfügbar.
HTTP 404: не удалось найти страницу
Страница, которую вы ищете, не существует или удалена. Ошибка 404, страница не найдена на сервере.
HTTP 403: доступ к ресурсу запрещён. У вас нет разрешения на доступ к этому материалу.
HTTP 500: произошла внутренняя ошибка сервера. Что-то пошло не так, попробуйте ещё раз позже.
HTTP 503: сервис временно недоступен. Это видео больше недоступно.
HTTP 404: 해당 페이지를 찾을 수 없어요
찾으시는 페이지가 존재하지 않거나 삭제되었습니다. 404 오류, 서버에서 페이지를 찾을 수 없음.
HTTP 403: 이 자료에 대한 접근이 거부되었어요. 이 콘텐츠를 볼 수 있는 권한이 없습니다.
HTTP 500: 내부 서버 오류가 발생했어요. 문제가 발생했으니 나중에 다시 시도해 주세요.
HTTP 503: 현재 서비스를 이용할 수 없습니다. 이 동영상은 더 이상 볼 수 없습니다.
HTTP 404: ページを見つけることができません
お探しのページは存在しないか削除されました。404 エラー、サーバーにページが見つかりませんでした。
HTTP 403: このリソースへのアクセスは拒否されました。このコンテンツを見る権限がありません。
HTTP 500: 内部サーバーエラーが発生しました。問題が発生しました。しばらく待ってから再度お試しください。
HTTP 503: 現在サービスをご利用いただけません。この動画はご覧いただけません。
"""

#: Placeholders that only their words give away; those that their shape gives away are made by rule (``shapes``).
WORDED = """
[INSERT COMPANY NAME HERE]
[INSERT YOUR ADDRESS HERE]
[Insert Product Name]
[ENTER PHONE NUMBER]
[ADD LOGO HERE]
[Your Company Name]
[your street address]
[YOUR SIGNATURE]
[your own headline here]
TBD: price
TBD: deliveryDate
TBD: phone number
"""

#: (before, after, whether the name is in capitals) of the placeholders of common template languages.
BRACKETS = (
    ("{{", "}}", False),
    ("{{ ", " }}", False),
    ("{%", "%}", False),
    ("{% ", " %}", False),
    ("${", "}", False),
    ("#{", "}", False),
    ("{", "}", False),
    ("%(", ")s", False),
    ("<%= ", " %>", False),
    ("<% ", " %>", False),
    ("<<", ">>", False),
    ("<< ", " >>", False),
    ("<", ">", True),
    ("[[", "]]", True),
    ("__", "__", True),
    ("@@", "@@", False),
    ("$$", "$$", True),
    ("%%", "%%", True),
    ("%", "%", True),
    ("[INSERT ", " HERE]", True),
)
NAMES = ("street", "zip_code", "first name", "userName", "home_postal_code", "7", "x")

#: Sentences about errors, scripts, filler and templates, as prose has them.
MENTION = """
In her talk she explains how a web server decides which error code it sends to a visitor.
The team measured that server errors had dropped by a third since the new cache went live in spring.
Our statistics show that most of the missing pages were requested through outdated links in old mails.
He remembers that the old site asked everyone to enable JavaScript, and many readers simply left.
Readers who had turned their scripts off could not see the player at all until we repaired it.
Typesetters have used lorem ipsum for centuries because readers ignore it, as the guest points out.
A chapter of the book is about gateways that fail when the process behind them starts too slowly.
Whenever the proxy was down, our downloader waited a while and then tried it again twenty times.
The release script stops with an error if somebody forgot a placeholder in one of the templates.
Before the launch we deleted all the dummy text and wrote proper descriptions for every product.
For a joke they printed access denied on their coffee mugs and sold them at the conference.
That list of open tasks has ninety entries, and the first one is about the cables.
En la charla cuenta cómo los errores del servidor bajaron a la mitad después del cambio.
Antes el sitio pedía a todos que activaran JavaScript y muchos lectores se marchaban.
Na palestra ela conta como os erros do servidor caíram pela metade depois da mudança.
Antes o site pedia que todos ativassem o JavaScript e muitos leitores iam embora.
Dans son exposé, elle raconte comment les erreurs du serveur ont diminué de moitié après le changement.
Avant, le site demandait à tous d'activer JavaScript et beaucoup de lecteurs partaient.
Im Vortrag erzählt sie, wie die Serverfehler nach dem Umbau auf die Hälfte zurückgingen.
Früher bat die Seite alle, JavaScript einzuschalten, und viele Leser gingen wieder.
В докладе она рассказывает, как ошибки сервера сократились вдвое после переделки.
Раньше сайт просил всех включить JavaScript, и многие читатели уходили.
강연에서 그는 서버 오류가 개편 뒤에 절반으로 줄었다고 이야기합니다.
예전에는 사이트가 모두에게 JavaScript를 켜라고 했고 많은 독자가 떠났습니다.
講演では、改修後にサーバーのエラーが半分に減ったことが語られています。
以前はサイトが全員に JavaScript を有効にするよう求め、多くの読者が去りました。
"""

#: Plain prose, so that a table of a few rows has a model of prose at all; beside a large one it weighs nothing.
PROSE = """
On Saturday morning the market square was full of people who had come to buy fruit and flowers.
My grandmother still keeps the letters that her brother wrote from the harbour town in winter.
We looked at the second half of the recording, and the noise of the wind was stronger than we had expected.
The old bridge, which was built by two engineers from the valley, carries the road over the river.
If you want to grow tomatoes, you should water them early and keep the soil warm at night.
El sábado por la mañana la plaza estaba llena de gente que compraba fruta y flores.
Mi abuela todavía guarda las cartas que su hermano le escribió desde el puerto.
El viejo puente lleva el camino sobre el río y todavía necesita una reparación.
Si quieres cultivar tomates, riégalos temprano y mantén caliente la tierra por la noche.
No sábado de manhã a praça estava cheia de gente que comprava frutas e flores.
Minha avó ainda guarda as cartas que o irmão lhe escreveu do porto.
A velha ponte leva a estrada sobre o rio e ainda precisa de reparos.
Se você quer plantar tomates, regue cedo e mantenha a terra quente à noite.
Samedi matin, la place du marché était pleine de gens qui achetaient des fruits et des fleurs.
Ma grand-mère garde encore les lettres que son frère lui a écrites depuis le port.
Le vieux pont porte la route au-dessus de la rivière et il a encore besoin de travaux.
Pour cultiver des tomates, il faut les arroser tôt et garder la terre chaude la nuit.
Am Samstagmorgen war der Marktplatz voller Menschen, die Obst und Blumen kauften.
Meine Großmutter bewahrt die Briefe noch auf, die ihr Bruder aus der Hafenstadt schrieb.
Die alte Brücke trägt die Straße über den Fluss und braucht noch etwas Pflege.
Wer Tomaten ziehen will, sollte sie früh gießen und die Erde nachts warm halten.
В субботу утром площадь была полна людей, которые покупали фрукты и цветы.
Моя бабушка до сих пор хранит письма, которые брат писал ей из портового города.
Старый мост ведёт дорогу через реку, и ему ещё нужен небольшой ремонт.
Чтобы вырастить помидоры, поливайте их рано и держите землю ночью в тепле.
토요일 아침 시장에는 과일과 꽃을 사러 온 사람들이 가득했습니다.
할머니는 오빠가 항구 도시에서 보낸 편지를 아직도 간직하고 계십니다.
오래된 다리는 강 위로 길을 이어 주며 아직 손볼 곳이 조금 있습니다.
토마토를 키우려면 일찍 물을 주고 밤에는 흙을 따뜻하게 해야 합니다.
土曜日の朝、市場の広場は果物や花を買う人たちでいっぱいでした。
祖母は兄が港町から送った手紙を今でも大切にしまっています。
古い橋は川の上に道を通していて、まだ少し手入れが必要です。
トマトを育てるなら、朝早く水をやり、夜は土を暖かく保ちましょう。
"""


def lines(block: str) -> list[str]:
    return [x for x in block.strip().split("\n") if x]


def shapes() -> list[str]:
    """Placeholders of every bracket and name."""
    return [f"{a}{name.upper().replace(' ', '_') if capital else name}{b}" for a, b, capital in BRACKETS for name in NAMES]
