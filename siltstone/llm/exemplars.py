"""Labelled exemplars: what stands on a page besides its article, and what stands there instead.

Each exemplar is a bag of the wordings of one kind of notice. In it, PH stands for a placeholder,
0 for a number and ID for a long hexadecimal name.
"""

from __future__ import annotations

# Residue, that is text that a script, a server or a template left where content should be.
RESIDUE = (
    # scripts are needed
    "you must need have to enable activate allow turn on switch on javascript in your browser settings and reload to use open run view this page site app shop",
    "please enable activate allow turn on switch on javascript in your browser settings and reload to continue",
    "javascript is disabled switched off not available turned off blocked the content page catalogue cannot be shown displayed without it",
    "we rely on javascript to render draw build show this page it seems to be off blocked disabled",
    "this view site page app shop website needs requires depends on javascript",
    "your browser is too old for this site app page cookies and javascript must be allowed on enabled",
    "loading if nothing happens enable allow activate javascript",
    "noscript page hidden content hidden",
    "bitte aktivieren erlauben sie javascript um diese seite anwendung zu nutzen sehen",
    "ohne javascript kann der inhalt nicht geladen angezeigt werden",
    "veuillez activer autoriser javascript pour continuer afficher la page",
    "您的浏览器不支持javascript 您的浏览器已禁用javascript 页面无法显示 页面无法加载",
    "请启用javascript后继续浏览 请开启javascript后刷新页面 请打开javascript后重试",
    # server and gateway pages
    "error fault status code 0 not found 0 forbidden 0 bad gateway 0 gateway time out timeout 0 service unavailable 0 internal server error 0 gone 0 bad request 0 unauthorized",
    "错误代码 0 错误 0",
    "incident reference request trace event ray id no 0 ID",
    "vorgang nr ID 0",
    "请求编号 ID 编号 0",
    "too many requests visits calls your address was limited throttled slowed down wait 0 seconds and try again reload",
    "something went wrong on our side at our end while this page was built please try again come back later in a moment",
    "cannot could not failed to connect reach open the database host server to please tell inform contact the administrator errno 0",
    "fatal error parse error warning notice uncaught typeerror undefined variable allowed memory used up in php on line 0 stack trace main 0",
    "java lang nullpointerexception illegalstateexception outofmemoryerror exception at page render run main cms shop site",
    "the address document resource page you asked for requested wanted could not be found served delivered by on this server",
    "we are unable to can't could not cannot find that page the page you are looking for what you wanted it may have been moved renamed deleted or never existed",
    "hmm well sorry oops whoops uh oh nothing here the link you followed is out of date gone broken",
    "access entry request denied blocked refused forbidden you are not allowed do not have permission to view open see this page folder resource",
    "your session login token has ended expired timed out sign in log in again to continue",
    "checking verifying inspecting your connection browser before you continue enter proceed this may take takes up to 0 seconds",
    "please confirm prove show that you are human not a robot pick select all pictures squares with a bridge bus lorry",
    "this site page can't be reached loaded right now the connection was refused reset closed",
    "the account of this website is closed suspended switched off contact your hosting provider company",
    "under maintenance the our systems servers are being updated serviced until 0 o'clock",
    "coming soon launching soon back soon we are working on this page please be patient",
    "this domain is parked reserved for sale make an offer ask the owner",
    "die angeforderte gewünschte aufgerufene adresse seite datei ist auf diesem server nicht vorhanden hinterlegt gefunden verfügbar",
    "seite inhalt datei nicht gefunden vorhanden verfügbar",
    "zugriff verweigert gesperrt nicht gestattet",
    "technische störung wartungsarbeiten wir sind in 0 minuten kürze bald wieder erreichbar da",
    "diese seite rubrik ist in arbeit befindet sich im aufbau wird gerade überarbeitet",
    "页面加载失败 页面加载超时 页面加载异常 请稍后重试 请刷新 请刷新页面",
    "抱歉 对不起 您访问的页面不存在 您查找的内容找不到了 您打开的内容已删除 您访问的内容不存在 请检查网址或返回首页 返回上一页",
    "网站建设中 页面建设中 栏目建设中 网站维护中 页面维护中 栏目维护中 敬请期待 敬请谅解",
    # filler
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur pellentesque habitant morbi tristique senectus netus malesuada fames ac turpis egestas vestibulum",
    "the a quick brown lazy sleepy forklift robot jumps over the lazy sleepy pallet conveyor",
    "hello world hello there this is your first very first post page article entry",
    "just another demo test sample post page item entry nothing to see yet",
    "this is a an sample example demo page article entry change edit it or remove delete it",
    "replace overwrite swap this passage paragraph block with text details a few words about your company business firm",
    "your our more main text copy content story goes comes will go here",
    "todo tbd fixme text copy wording to follow by marketing from brochure",
    "insert add type company product site description summary here below max 0 signs",
    "photo image video picture caption goes here pending placeholder",
    "sample example demo dummy heading headline title page one two a b",
    "company name ltd surname street 0 0 town city",
    "word blah text word text blah",
    "asdf qwer yxcv qwertz jklö test foo bar 0",
    "blindtext hier steht folgt kommt später der richtige echte endgültige text inhalt",
    "bildtext überschrift absatz teaser text folgt ergänzen einfügen",
    "文章简介占位 公司标题占位 产品简介占位 文章标题占位 产品标题占位 公司简介占位",
    "此处为占位内容 此处为示例文字 此处为测试内容 请替换为正式介绍 请修改为正式内容",
    # templates whose blanks were not filled
    "PH PH PH PH",
    "PH was founded in PH and makes PH for customers in PH",
    "PH head of PH leads a team of PH people at PH",
    "our plant in PH delivers PH to PH and reached PH last year",
    "read how PH saved PH with PH",
    "welcome to PH call us in PH or write to PH",
    "copyright text for PH goes under PH",
    "about PH",
    "willkommen bei PH ihrem partner für PH in PH",
    "PH wurde PH in PH gegründet und fertigt PH",
    "PH成立于PH 总部位于PH 主要生产PH",
    "联系我们 PH 地址 PH",
    "error PH the call to PH failed",
    "sorry PH could not answer PH",
    "fehler PH bei PH",
    "PH 调用失败 PH",
)

# Furniture, that is what surrounds an article. Kinds that stand as a line of their own.
FURNITURE = (
    "home menu search contact about us news events products solutions services service support careers blog press log in my account cart 0 shop partners industries sustainability downloads locations investors",
    "startseite menü suche kontakt über uns aktuelles produkte lösungen leistungen branchen karriere presse anmelden warenkorb standorte downloads",
    "首页 登录 注册 关于我们 联系我们 产品中心 解决方案 新闻动态 服务支持 加入我们 投资者关系 网站地图 资料下载",
    "en de 中文",
    "for the best experience please enable javascript",
    "für alle funktionen bitte javascript aktivieren",
    "建议启用javascript以获得完整体验",
    "home service markets technology companies tenders reports archive press news products unternehmen 产业",
    "we use cookies to improve this site ok accept all reject settings manage preferences i agree read more in our cookie policy",
    "this website stores small files on your device so that we can count visits",
    "by going on you accept our use of cookies and similar techniques",
    "some cookies are necessary others help us to show you suitable offers from",
    "your privacy matters and 0 partners process data such as device ids",
    "diese seite verwendet technisch notwendige und statistische cookies alle akzeptieren nur notwendige einstellungen mehr erfahren",
    "mit ihrer zustimmung speichern wir und 0 partner daten auf ihrem gerät",
    "wir setzen cookies ein um laufend zu verbessern",
    "本网站使用cookie以提升您的体验 接受全部 同意 了解更多 设置",
    "继续浏览即表示您同意我们的隐私政策",
    "reject settings accept all",
    "subscribe to our newsletter enter your e mail address sign up",
    "get the weekly digest of straight to your inbox",
    "newsletter abonnieren ihre e mail adresse absenden",
    "订阅我们的邮件 请输入邮箱 提交",
    "request a quote now and receive an answer within 0 hours",
    "jetzt angebot anfordern",
    "立即咨询",
    "share this page share post send print e mail this listen to this article leave a reply 0 comments",
    "seite teilen drucken kommentare 0",
    "分享到 打印 收藏 评论 0",
    "follow us feed video photo",
    "folgen sie uns",
    "关注公众号",
    "back to top site map legal notice privacy terms",
    "nach oben impressum datenschutz agb",
    "privacy policy terms of use imprint",
    "隐私政策 法律声明",
    "© 0 all rights reserved",
    "© 0 alle rechte vorbehalten",
    "版权所有 © 0 集团",
    "phone 0 0 0 telefon 0 0 0",
    "电话 0 0",
    "备案号 0号",
    "地址 工业园0号",
    "0 works road werkstraße 0",
    "made with care in",
    "is a member of the chamber of industry statements on this website may contain forward looking remarks",
)

# Headings of lists of other articles.
SIDEBARS = (
    "related articles", "more from this author", "you may also like", "most read", "latest posts", "archive", "tags",
    "ähnliche beiträge", "meistgelesen", "schlagworte", "archiv",
    "相关阅读", "热门文章", "推荐产品", "标签",
)

# Messages about a call, which are not residue however short.
MESSAGES = (
    "timeout",
    "timeout after 0 ms",
    "connection reset by peer while reading chunk 0",
    "upstream answered 0 after 0 ms attempt 0",
    "api key rejected for endpoint",
    "0 model unknown at this endpoint",
    "0 invalidargument does not take search in thinking mode",
    "0 throttled retry in 0 ms",
    "quota exceeded 0 of 0 calls",
    "answer cut at 0 tokens",
    "page 0 for source 0 answer kept",
    "search tool returned html instead of json 0 bytes",
    "json parse error at char 0 expected after model",
    "template arg company must be a string got null call 0",
    "the prompt asks for javascript output which refuses",
    "模型 不支持联网搜索",
)
