"""Lists and numbers that results depend on."""

# Query parameters that only track a visit.
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "utm_name", "utm_reader", "fbclid", "gclid", "gclsrc", "dclid", "msclkid", "mc_cid", "mc_eid", "igshid", "ref_src", "yclid", "spm", "_ga"]

# Parts of urls that tell the kind of source, in order of precedence; anything else is DEFAULT_SOURCE.
SOURCES = {
    "影音": ["youtube.com", "youtu.be", "/videos/", "/reel", "tiktok.com", "bilibili"],
    "社群": ["facebook.com", "fb.com", "fb.watch", "instagram.com", "threads.net", "threads.com", "twitter.com", "//x.com/"],
    "論壇": ["ptt.cc", "dcard.tw", "mobile01.com", "gamer.com.tw", "bahamut", "eyny.com", "komica"],
    "電商": ["shopee.", "momoshop", "momo.com.tw", "pchome", "books.com.tw", "rakuten", "amazon.", "ruten"],
}
DEFAULT_SOURCE = "媒體"

# Parts of hosts and urls that tell the region, and of urls that tell a listing page.
REGION_HK, REGION_TW, REGION_TW_URL = [".hk", "hongkong", "hk01", "stheadline"], [".tw", "my-best.com", "pixnet", "vocus"], ["/tw/", "tw."]
LISTING = ["/search", "/list", "/category", "/categories", "/tag/", "/tags/", "/promotion", "s=", "q=", "query="]

# Sub-domains and paths of log-in, consent and error pages.
WALL_SUBDOMAINS = ["auth", "login", "signin", "sso", "consent", "account", "passport", "id"]
WALL_PATHS = ["/login", "/signin", "/consent", "/sso", "/error", "/blocked", "/verify", "/captcha"]

# Texts of pages that browsers and servers show instead of an article, and of pages that block crawlers.
BROWSER_ERRORS = [
    "This site can’t be reached", "This site can't be reached", "refused to connect", "took too long to respond",
    "ERR_CONNECTION", "ERR_NAME_NOT_RESOLVED", "ERR_TIMED_OUT", "ERR_CONNECTION_REFUSED", "ERR_CONNECTION_TIMED_OUT", "ERR_ADDRESS_UNREACHABLE",
    "DNS_PROBE_FINISHED", "ERR_SSL", "ERR_CERT", "ERR_EMPTY_RESPONSE", "無法連上這個網站", "拒絕連線", "回應時間過長", "找不到該網頁的位址",
    "no proxy", "Checking the proxy", "需要確認您的連線是安全的", "Enable JavaScript and cookies to continue", "Checking your connection",
    "Verifying you are human", "Just a moment", "DDoS protection by Cloudflare", "cf-browser-verification", "請稍候，並依據指示", "Verify you are human",
    "Performance & security by Cloudflare",
]
HTTP_ERRORS = ["403 forbidden", "404 not found", "error 403", "error 404", "access denied", "forbidden", "not found", "503 service", "拒絕存取", "找不到網頁", "頁面不存在", "請求被拒絕", "禁止存取"]
BLOCK_PAGES = [
    "禁止爬取", "禁止爬蟲", "禁止抓取", "您的請求被拒絕", "請求被拒絕", "access denied", "請完成驗證", "驗證您是人類", "輸入驗證碼", "我們偵測到", "異常流量",
    "just a moment", "checking your browser", "enable javascript and cookies", "attention required",
]

# Phrases of lines at the end of articles.
BOILERPLATE = ["不得轉載", "版權所有", "著作權所有", "未經授權", "禁止轉載", "點我加入", "訂閱電子報", "立即下載", "下載APP", "下載 APP", "更多內容請見", "授權轉載"]

# Part of a model's name, US dollars for a million input and output tokens; the first that fits counts.
PRICES = [
    ("gemini-2.5-flash-lite", 0.10, 0.40), ("gemini-2.5-pro", 1.25, 10.0), ("gemini-2.5-flash", 0.30, 2.50), ("flash-lite", 0.10, 0.40), ("flash", 0.30, 2.50),
    ("opus", 5.0, 25.0), ("sonnet", 3.0, 15.0), ("haiku", 1.0, 5.0), ("gpt-4o-mini", 0.15, 0.60), ("gpt-4o", 2.50, 10.0), ("gpt", 2.50, 10.0),
]
DEFAULT_PRICE, EMBED_PRICE = (0.30, 2.50), 0.025

# Sizes and thresholds.
TOP_KEYWORDS, PER_ARTICLE, VOCABULARY, MAX_DF = 50, 10, 500, 0.95
ASSOC_VOCABULARY, ASSOC_SUPPORT, ASSOC_CONFIDENCE, ASSOC_RULES, ASSOC_SETS = 30, 0.10, 0.5, 15, 20
CHUNK, OVERLAP, LEAST_CHUNK, TOP_K = 600, 80, 20, 5
LATEST_EVENTS = 500

# Phrases that lead on to paid content, and hosts whose texts end without one, with the least length of a whole text.
PAYWALL = [
    "訂戶限定", "解鎖訂戶限定", "查看訂閱方案", "不限篇數暢讀", "立即購買", "訂閱看全文", "會員專屬", "付費訂閱", "登入後繼續閱讀", "升級會員",
    "訂閱解鎖", "加入會員看全文", "本文為訂閱", "付費會員", "訂閱會員專屬", "本篇為訂閱限定", "訂閱以閱讀全文",
]
PAYWALL_HOSTS = {"businessweekly.com.tw": 700, "theinitium.com": 700, "ctee.com.tw": 700}

# Words of cookie banners, three of which make one; and phrases of blocks that list other articles.
COOKIES = [
    "cookie", "cookies", "gdpr", "consent", "同意管理", "隱私權", "隱私政策", "personal data", "個人資料", "adchoices", "targeted advertising",
    "performance cookies", "functional cookies", "audience measurement", "本網站使用", "這些 cookie", "這些 cookies",
]
LISTING_BLOCKS = ["延伸閱讀", "相關文章", "推薦閱讀", "熱門文章", "entertainment", "美麗佳人編輯部", "articlelist", "storylist", "postlist", "item-list", "card-list"]

# Parts of class names and ids, and what they add to a block's weight of 1.
WEIGHTS = [(["main", "content", "center", "article"], 0.3), (["side", "sidebar", "widget", "aside"], -0.5), (["header", "footer", "nav"], -0.4)]

# Limits of colour families. Dark below, pale below, white above, red around 0 degrees, brown below; then hues up to a degree.
COLOR_LIMITS = (0.22, 0.14, 0.82, 15, 0.75)
HUES = [(45, "橙"), (70, "黃"), (160, "綠"), (200, "青"), (255, "藍"), (290, "紫")]

# Marks around the urls of a pasted list.
LIST_MARKS = "^[<>\"'，。、]+|[<>\"'，。、]+$"

# Largest lengths of a row of content, least lengths of an article in structured data and of a text that needs no description.
URL_CAP, TITLE_CAP, TEXT_CAP, LEAST_BODY, LEAST_TEXT = 2048, 512, 50_000, 200, 200

# Days after which finished jobs go, how many go at a time, minutes after which a silent job has failed, entities of a report and least salience.
KEEP_DAYS, SWEEP, SILENT_MINUTES, TOP_ENTITIES, LEAST_SALIENCE = 30, 500, 90, 25, 0.01

# What a part of a url with a dot counts beside its length when site templates are compared, and the scope of terms that holds for all sources.
DOTTED, ALL_SCOPE = 1000, "全部"

# Places of shares and of lifts as they are shown and ranked; gates and additions of filter candidates.
SHARE_PLACES, LIFT_PLACES = 3, 2
LEAST_RATE, LEAST_GAP, FILLER = 0.66, 0.4, 0.3

# Hosts of cloud metadata; networks that no fetch may reach, of either kind; and those of them that are meant by an address within a v6 one.
METADATA_HOSTS = ["metadata.google.internal", "169.254.169.254"]
V4_INTERNAL = [
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16",
    "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4",
]
V4_BLOCKED = [*V4_INTERNAL, "224.0.0.0/4"]
V6_BLOCKED = ["::/128", "::1/128", "64:ff9b:1::/48", "100::/64", "2001::/23", "2001:db8::/32", "fc00::/7", "fe80::/10", "ff00::/8"]

# Selectors that are too wide to be kept, least characters of a text by a kept selector, and levels of a path above its element.
WIDE_SELECTORS = ["body", "html", "main", "div", "*", "article", "section"]
LEAST_SELECTED, PATH_LEVELS = 300, 20

# Keywords of a cluster, and signals of a kind.
CLUSTER_KEYWORDS, SIGNALS = 8, 12

# Heads of the three exported tables, and the mark that spreadsheets want at the front of a file.
EXPORT_HEADS = {
    "tfidf": ["rank", "keyword", "weight"],
    "association": ["type", "antecedent_or_items", "consequent", "support", "confidence", "lift", "count"],
    "sentiment": ["metric", "value"],
    "entities": ["entity", "type", "salience", "mentions"],
}
BOM = "\ufeff"

# Attributes of images that are loaded late, in order; images of a sample; scores at which a text is surely or likely the article.
LAZY_ATTRIBUTES = ["data-src", "data-original", "data-lazy", "data-lazy-src", "data-actualsrc", "data-echo", "data-hi-res-src"]
SAMPLE_SIZE, SURE_SCORE, LIKELY_SCORE = 10, 1500, 800
