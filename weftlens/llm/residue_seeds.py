"""Labelled examples of residue, written from general knowledge of web pages and templates, and the shapes of placeholders.

No sentence here is taken from a table that the engine is tested on.
"""

from __future__ import annotations

from http import HTTPStatus
from itertools import product

# Error messages and notices that scripts are required, as servers and applications show them.
NOTICES = [
    "JavaScript is required to use this website.", "JavaScript must be enabled in order for you to use this site.", "It looks like JavaScript is turned off in your browser settings.", "Turn it on in your settings and reload the page.", "Your browser does not support JavaScript or it has been disabled.", "JavaScript is disabled in your browser.", "JavaScript is not available.", "JavaScript is switched off.", "This application requires JavaScript.", "You need to enable JavaScript to run this app.", "You need to turn on JavaScript and cookies to use this page.", "This page requires scripts to be turned on.", "This site requires JavaScript and cookies to work properly.",
    "We're sorry but this app doesn't work properly without JavaScript enabled.", "Scripts are blocked by your browser.", "Your browser is blocking scripts.", "Your client blocks cookies.", "Allow scripts for this page and try again.", "Cookies must be enabled.", "Scripts and cookies must be allowed for this site.", "Please allow cookies and scripts, then refresh.", "Please wait while we verify your browser.", "Checking your browser before you proceed.", "Checking your connection, this may take a few seconds.", "Checking if the site connection is secure.", "Verifying that you are human.", "One moment, please.",
    "Oops! Page not found.", "Oops, something went wrong.", "Sorry, something went wrong.", "Something went wrong on our end.", "Something went wrong. Please try again later.", "An unexpected error has occurred.", "An error occurred while processing your request.", "We're having trouble loading this page.", "The page you are looking for does not exist.", "The page you requested does not exist or has been moved.", "The page you asked for is no longer available.", "The requested page could not be found.", "The requested URL was not found on this server.", "This page could not be displayed.", "The page could not be loaded.", "The document you asked for could not be shown.", "File not found", "Go back to the home page.", "Return to the start page.", "Go back to the previous page or try again later.", "Try again later.", "Please try again in a few minutes.",
    "The server encountered an internal error and was unable to complete your request.", "The server is temporarily unable to service your request.", "The server did not respond in time.", "The service is temporarily unavailable.", "The site is down for maintenance.", "This site is currently under maintenance. Please check back later.", "We will be back soon.", "Too many requests. Please slow down.", "Rate limit exceeded.", "You have been rate limited. Retry after 60 seconds.", "You have been blocked.", "Error establishing a database connection", "Could not connect to database.", "Unable to connect to the server.", "Unable to connect to the database server.", "Please contact your administrator.", "Contact the system administrator if the problem persists.", "The request timed out.", "Connection timed out", "Connection refused",
    "Your session has timed out.", "Your session has expired. Please log in again.", "Session has expired, sign in to continue.", "Please sign in again to continue.", "Please log in to view this page.", "You must be signed in to see this content.", "Access has been denied.", "You don't have permission to access this page on this server.", "You do not have permission to open this page.", "You do not have permission to view this document.", "You are not authorized to view this resource.", "Authentication required", "Traceback (most recent call last):", "Stack trace:", "stack: main.run -> worker.open -> timeout", "Unhandled exception", "NullPointerException", "TypeError: Cannot read properties of undefined", "Request ID:", "Reference #",
    "Bitte schalten Sie JavaScript in Ihrem Browser ein.", "Bitte aktivieren Sie JavaScript.", "Bitte aktivieren Sie JavaScript, um diese Website zu nutzen.", "JavaScript ist in Ihrem Browser deaktiviert.", "Um diese Seite anzuzeigen, muss JavaScript aktiviert sein.", "Diese Seite benötigt JavaScript.", "Diese Anwendung benötigt JavaScript und Cookies.", "Diese Anwendung läuft nicht ohne Skripte.", "Ihr Browser blockiert Skripte.", "Ihr Browser hat Skripte abgeschaltet.", "Die angeforderte Seite wurde nicht gefunden.", "Die gesuchte Seite existiert nicht.", "Seite nicht gefunden", "Die Seite konnte nicht geladen werden.", "Es ist ein interner Fehler aufgetreten.", "Interner Fehler des Servers", "Interner Serverfehler.", "Fehler beim Laden der Seite.", "Versuchen Sie es später erneut.", "Bitte versuchen Sie es später noch einmal.", "Bitte wenden Sie sich an den Administrator.", "Der Zugriff wurde verweigert.", "Sie haben keine Berechtigung, diese Seite anzuzeigen.", "Ihre Sitzung wurde beendet.", "Ihre Sitzung ist leider abgelaufen.", "Bitte melden Sie sich neu an.", "Bitte melden Sie sich wieder an.", "Der Server ist zurzeit nicht erreichbar.", "Der Vorgang wurde abgebrochen.", "Die Anfrage wurde abgebrochen.", "Zeitüberschreitung der Anfrage.",
    "자바스크립트를 활성화해 주세요.", "이 사이트를 이용하려면 자바스크립트가 필요합니다.", "이 페이지를 보려면 스크립트를 허용해 주세요.", "브라우저에서 스크립트가 차단되었습니다.", "브라우저 설정을 확인해 주세요.", "스크립트가 꺼져 있어 페이지를 표시할 수 없습니다.", "요청하신 페이지가 존재하지 않습니다.", "요청하신 주소를 찾을 수 없습니다.", "존재하지 않는 페이지입니다.", "내부 서버 오류", "서버 오류가 발생했습니다.", "서버에서 내부 오류가 발생했습니다.", "오류가 발생했습니다. 다시 시도하세요.", "나중에 다시 시도해 주세요.", "잠시 후 다시 시도해 주세요.", "접근 권한이 없습니다.", "접근이 거부됨", "권한을 확인해 주세요.", "로그인이 만료되었습니다.", "세션이 만료되어 다시 로그인해야 합니다.", "다시 로그인해 주세요.", "요청 시간이 초과되었습니다.", "관리자에게 문의하세요.", "오류 404", "404 오류 페이지",
    "请在浏览器中启用 JavaScript。", "请启用 JavaScript 后重试。", "请启用脚本后再查看。", "本网站需要 JavaScript 才能正常运行。", "您的浏览器未启用脚本。", "您的浏览器禁用了 JavaScript。", "浏览器禁用了脚本，无法显示此页面。", "无法显示此网页。", "找不到您要的页面。", "您访问的网页不存在或已被删除。", "您要查看的页面不存在。", "服务器发生内部错误。", "服务器内部错误", "服务器出错，请稍后再试。", "服务暂时不可用，请稍后重试。", "请稍后再试", "您没有访问权限。", "您没有权限查看此页面。", "您没有权限访问。", "拒绝访问", "访问被拒绝。", "登录已过期，请重新登录。", "会话已过期", "会话超时，请重新登录。", "请求超时。", "请联系管理员。", "错误 404", "404 错误页面", "请求编号：", "错误代码：",
]
#: Status lines of servers, by rule from the public registry of codes.
STATUS_LINES = [form.format(s.value, s.phrase) for s in HTTPStatus if s.value >= 400 for form in ("{0} {1}", "HTTP {0} - {1}", "Error {0}: {1}", "Error {0}\n{1}", "{1}")]

# Filler text of typesetters, its usual beginning and parts of the work that it was cut from.
LATIN = [
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua.", "Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat.", "Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur.", "Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum.",
    "Neque porro quisquam est, qui dolorem ipsum quia dolor sit amet, consectetur, adipisci velit.", "Sed ut perspiciatis unde omnis iste natus error sit voluptatem accusantium doloremque laudantium, totam rem aperiam.", "Nemo enim ipsam voluptatem quia voluptas sit aspernatur aut odit aut fugit.", "At vero eos et accusamus et iusto odio dignissimos ducimus qui blanditiis praesentium voluptatum deleniti atque corrupti.", "Nam libero tempore, cum soluta nobis est eligendi optio cumque nihil impedit quo minus id quod maxime placeat.", "Vivamus sagittis lacus vel augue laoreet rutrum faucibus dolor auctor.", "Cras justo odio, dapibus ac facilisis in, egestas eget quam.", "Pellentesque habitant morbi tristique senectus et netus et malesuada fames ac turpis egestas.",
]
# Key strokes and words that are repeated to fill space.
FILLER_KEYS = ["xxx", "abc", "aaa", "bla", "blah", "asdf", "qwerty", "test", "text", "foo", "foo bar", "lorem", "dummy", "123", "zzz", "..."]
# Filler passages in prose.
FILLERS = [
    "This is dummy text that will be replaced later.", "This paragraph is only a placeholder and shows how the page will look.", "This is placeholder text.", "Sample text, sample text, sample text.", "Sample paragraph for layout purposes only.", "Placeholder text goes here.", "Your text goes here.", "Add your content here.", "Replace this text with your own content.", "Replace it with the final copy later.", "Content coming soon.", "Dummy copy.", "Text to follow.",
    "Hier steht Blindtext.", "Dies ist ein Blindtext.", "Hier steht später der richtige Inhalt.", "Dieser Text dient nur als Platzhalter und wird später ersetzt.", "Dieser Absatz ist nur ein Muster für das Aussehen der Seite.", "Mustertext", "Beispieltext, bitte ersetzen.",
    "여기에 예시 문장이 들어갑니다.", "여기에 내용이 들어갑니다.", "이 글은 화면 모양을 보이기 위한 예시이며 나중에 실제 내용으로 바뀝니다.", "견본 문단입니다.", "임시 문구입니다.", "예시 글입니다.",
    "这里是示例文本。", "此处为占位文字，稍后替换为正式内容。", "本段文字仅用于展示版面效果。", "示例段落，稍后将替换。", "占位文本",
]

# What an instruction asks for, and how it asks, by language; the mark stands for what.
ASKED = {
    "en": (["name", "your name", "date", "title", "serial number", "value", "comment", "short description", "company name", "address", "reviewer name", "text"], ["insert {} here", "insert {}", "enter {}", "enter {} here", "fill in {}", "add {} here", "your {}", "{} goes here", "TBD: {}", "to be filled in: {}", "replace with {}", "choose {}"]),
    "de": (["Name", "Datum", "Titel", "Nummer", "Wert", "Kommentar", "kurze Beschreibung", "Firma", "Name der Firma", "Name des Kunden", "Text"], ["{} hier einfügen", "{} einfügen", "{} eintragen", "{} hier eintragen", "{} eingeben", "{} ergänzen", "bitte {} eintragen", "Ihr {}"]),
    "ko": (["이름", "날짜", "제목", "번호", "값", "의견", "간단한 설명", "회사 이름", "담당자 이름", "검토 담당자 이름"], ["여기에 {} 입력", "{}을 입력하세요", "{}를 입력하세요", "{} 입력", "{} 기입", "{}"]),
    "zh": (["姓名", "日期", "标题", "编号", "数值", "备注", "简要说明", "公司名称", "负责人姓名", "审核员姓名", "联系人姓名"], ["{}", "您的{}", "此处填写{}", "请输入{}", "请填写{}", "在此输入{}", "填写{}", "插入{}"]),
}
#: Instructions in the brackets that they stand in, by rule.
INSTRUCTIONS = [b.format(how.format(what)) for what, how in [pair for things, ways in ASKED.values() for pair in product(things, ways)] for b in ("[{}]", "<{}>", "({})")] + [b.format(how.format(what)) for k in ("ko", "zh") for what, how in product(*ASKED[k]) for b in ("【{}】", "（{}）", "＜{}＞")]
# Other instructions.
INSTRUCTIONS += ["[TBD]", "[TODO]", "[to be determined]", "TODO: write this section", "TODO: replace this text", "TODO: add text", "TODO: fill in", "TODO: describe", "____", "________", "________ (name)", "________ (fill in)", "____ (date)", "[Name]", "[Date]", "[Title]", "[Your Company]"]
#: Dates that were never filled in, by rule.
INSTRUCTIONS += [sep.join(p) for sep in "/.-" for p in [*product(("XX", "DD", "TT", "MM"), ("XX", "MM", "DD"), ("XXXX", "20XX", "YYYY", "JJJJ"))]] + [f"{y}{a}{gap}{m}{b}{gap}{d}{c}" for a, b, c, gap in (("年", "月", "日", ""), ("년", "월", "일", " ")) for y in ("20XX", "XXXX") for m in ("X", "XX") for d in ("X", "XX")]

# Marks that enclose the name of a value in template languages, opening and closing.
PLACEHOLDER_MARKS = [("{{", "}}"), ("${", "}"), ("#{", "}"), ("<<", ">>"), ("<%=", "%>"), ("<%", "%>"), ("@@", "@@"), ("%%", "%%"), ("__", "__"), ("[[", "]]"), ("{%", "%}"), ("{", "}")]
# What stands between the marks: names, calls, filters, tags with arguments and numbered slots of template languages.
PLACEHOLDER_INSIDES = ["name", "name", "name", "lot number", "name of user", "name of the user", "a|b", "a | b", "a | b(0)", "a|b:\"c\"", "a | b: 'c'", "a()", "a(b)", "a(b, c)", "a[0]", "a['b']", "a:b", "a:0", "0", "0", "0:a", "if a", "if a == b", "if a == 'b'", "for a in b", "end a", "include 'a'", "#a", "#if a", "/a", "> a", "a ? b : c", "a or b", "a + b", "-", "a/b", "@a", "_a"]
# Data, code and prose between the same marks.
MARKED_DATA = ["{\"a\": 0}", "{\"a\": 0, \"b\": 0}", "{\"a\": \"b\", \"c\": \"d\"}", "{'a': 0, 'b': 'c'}", "{a: 0, b: 0}", "{\"a\": [0, 0]}", "{\"a\":0,\"b\":0}", "{\"a\":\"b\"}", "{0, 0}", "{0, 0, 0}", "{0,0}", "{a, b}", "{a, b, c}", "{ return a; }", "{ a = b; c = d; }", "{\n a: b;\n c: d;\n}", "[[0, 0], [0, 0]]", "[[0,0],[0,0],[0,0]]", "[[0, 0]]", "[[0,0]]", "<<a b c d e f>>", "<< 0 >>", "<<0>>", "__a b c d e f g, a b c d.__", "{a b c d e f g, a b c d e.}", "%% a b c d e f %%", "@@ -0,0 +0,0 @@", "@@ a b c d e, f g. @@", "[[a b c d e f g, a b.]]"]
# Names that templates ask for.
TEMPLATE_NAMES = ["name", "first_name", "lastName", "user", "user.name", "username", "customer", "date", "today", "title", "subject", "project_name", "count", "total", "email", "address", "city", "company", "station", "value", "label", "price", "order_id", "item.title", "report.date"]
# Names between such marks in code and formulas that stand for themselves.
CODE_NAMES = ["__init__", "__main__", "__file__", "__name__", "__doc__", "__all__", "__version__", "__repr__", "__str__", "__dict__", "__call__", "__enter__", "__exit__", "__iter__", "__next__", "__len__", "__new__", "__class__", "__slots__", "__getattr__", "__setattr__", "__del__", "__eq__", "__hash__", "__pycache__", "{train}", "{val}", "{test}", "{x}", "{y}", "{a}", "{n}", "{i}", "{k}", "{true}", "{false}", "{null}", "{}"]
# Quotation marks; what stands between them is spoken about, not used.
QUOTES_OPEN, QUOTES_CLOSE = "`'\"“‘„«‹「『”’", "`'\"”’“»›」』"
