"""Held-out cases for the residue operator: none of them is an example that its models are fitted on."""

NEUTRAL = [
    "My grandmother planted roses along the southern wall.", "The committee will meet on Thursday to discuss the annual budget.", "Please try again with a larger brush size.", "She opened the page of her notebook and began to read.", "The server brought us two plates of pasta and a carafe of water.", "Access to the garden is through the kitchen door.", "We requested a quiet room, and the hotel found one on the third floor.", "A session with the physiotherapist lasts about forty minutes.", "The bridge was closed for maintenance in the spring of 1987.", "His error was to trust the first map he bought.", "The old library does not lend books to visitors.", "You should contact the school before the holidays begin.", "Rain is expected later in the afternoon.", "The author was denied a visa twice before he could travel.",
    "Not every bird that sings at dawn is a thrush.", "The train to the coast leaves at half past six.", "The document describes how the cells were grown.", "Your letter of last week was read to the whole class.", "We turned the boat round and rowed back to the start.", "In the browser war of the nineties two companies fought for the desktop.", "The script of the play was lost for almost a century.", "Return the cups to the shelf when you have washed them.", "A temporary fence now stands around the excavation.", "The judge found that the page had been added later.", "The sample was heated to ninety degrees and cooled slowly.",
    "Das Wetter war gestern sehr schön und wir gingen spazieren.", "Der Zug nach Hamburg fährt heute von Gleis sieben.", "Die Seite des Buches war mit Bleistift beschrieben.", "Meine Schwester arbeitet seit Jahren als Lehrerin.", "Bitte stellen Sie die Stühle nach der Sitzung wieder zurück.", "Der Fehler im Motor wurde erst nach der Fahrt gefunden.", "Sie haben den Garten im Frühling neu angelegt.", "Wir suchten den Schlüssel und fanden ihn unter der Matte.", "Später kam der Nachbar und brachte einen Kuchen.", "Die Anfrage des Ministers blieb ohne Antwort.", "Im Museum darf man die Bilder nicht berühren.", "Der Text des Liedes stammt aus dem Mittelalter.",
    "오늘은 날씨가 좋아서 공원에서 산책을 했다.", "할머니는 해마다 봄이면 마당에 꽃을 심으신다.", "회의는 다음 주 목요일 오후에 열릴 예정이다.", "그 책의 마지막 장을 읽고 나는 한참 동안 울었다.", "기차는 여섯 시에 서울역에서 출발한다.", "요청한 자료는 내일까지 보내 드리겠다고 했다.", "아이들은 강가에서 돌을 던지며 놀았다.", "서버실의 온도는 늘 스무 도로 맞춰져 있다.",
    "今天天气很好，我们去公园散步。", "祖母每年春天都在院子里种花。", "会议定于下周四下午举行。", "他翻到书的最后一页，沉默了很久。", "火车六点从北京站出发。", "孩子们在河边扔石头玩。", "请把杯子洗干净后放回架子上。", "这家餐厅的服务员非常热情。",
]

UNSEEN = [
    "Please enable JavaScript and reload this page.", "This website requires JavaScript to be enabled.", "JavaScript must be turned on to use this application.", "You need JavaScript enabled to view this page.", "Your browser does not support scripts, please turn them on.", "Please turn on cookies and reload the page.", "The page you are trying to view does not exist.", "The requested page does not exist or has been removed.", "Sorry, the page you are looking for could not be found.", "Sorry, an unexpected error occurred. Please try again later.", "An error occurred while loading this page.", "Something went wrong while processing your request.", "The server could not complete your request.", "The server is down for maintenance, please try again later.", "Service temporarily unavailable. Please try again in a few minutes.",
    "Your session timed out, please sign in again.", "You do not have permission to access this document.", "You are not authorized to access this page.", "Unable to connect to the database.", "Could not connect to the server.", "Error 418: I'm a Teapot", "HTTP 451 - Unavailable For Legal Reasons", "Too many requests, please try again later.",
    "Bitte aktivieren Sie JavaScript in Ihrem Browser.", "Diese Website benötigt JavaScript und Cookies.", "Die gesuchte Seite wurde nicht gefunden.", "Es ist ein Fehler aufgetreten. Bitte versuchen Sie es später erneut.", "Sie haben keine Berechtigung, diese Website anzuzeigen.", "Ihre Sitzung ist abgelaufen, bitte melden Sie sich an.",
    "이 사이트를 보려면 자바스크립트를 허용해 주세요.", "요청하신 페이지를 표시할 수 없습니다.", "서버 내부에서 오류가 발생했습니다. 나중에 다시 시도하세요.", "세션이 만료되었습니다. 다시 로그인해 주세요.",
    "请在浏览器中启用脚本后重试。", "您访问的页面不存在或已被移动。", "服务器内部发生错误，请稍后重试。", "会话已超时，请重新登录。",
    "Sed perspiciatis dolor laboris voluptate nulla officia commodo sint veniam.", "Lorem tempor magna aliquip incididunt ipsum labore et consequat.", "zzz zzz zzz zzz zzz zzz zzz zzz zzz", "foo bar foo bar foo bar foo bar foo bar",
    "This is only placeholder text and will be replaced.", "Dieser Absatz dient nur als Platzhalter.", "本段文字仅为占位，稍后将替换。",
    "[enter your address here]", "<insert title here>", "(fill in your name)", "[Datum hier eintragen]", "<이름을 입력하세요>", "【此处填写日期】", "[please add your comment here]", "<type your title here>", "(your full address goes here)", "[Bitte Datum und Namen eintragen]", "<연락처를 입력하세요>", "【请在此填写地址】", "JavaScript appears to be disabled in this browser.", "We could not find the page you asked for.", "You have been signed out, please log in again.", "Der Server hat nicht rechtzeitig geantwortet, bitte versuchen Sie es erneut.", "Order {{ order.id }} was shipped.", "Hello ${userName}, welcome back.", "DD.MM.20XX",
]
