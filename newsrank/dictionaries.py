"""Thresholds, word lists and small lookup tables the rules depend on.

Everything here is plain data. Larger dictionaries (institutions, listed symbols, company
names, sectors) are arguments: the operators take them as DataFrames, so a deployment keeps
them in tables of its own.
"""

# --- fixed values: factor weights and bounds -------------------------------------------
FACTOR_WEIGHTS = {"M": 0.26, "B": 0.16, "T": 0.16, "I": 0.14, "H": 0.10, "A": 0.10, "Q": 0.08}
FACTORS = ["M", "B", "T", "I", "H", "A", "Q", "Rel"]
SCORING_VERSION = 6
TIER_BOUNDS = {"S": (0.85, 1.00), "A": (0.60, 0.84), "B": (0.35, 0.59), "C": (0.15, 0.34), "D": (0.00, 0.14)}
BREADTH_VALUES = {"cross_market": 1.00, "market_index": 0.80, "sector": 0.60, "multi_asset": 0.35,
                  "single_asset": 0.15}
STATUS_MULTIPLIER = {"VERIFIED": 1.0, "PROBABLE": 0.95, "UNVERIFIED": 0.75, "DISPUTED": 0.50}
TIMELINESS_HALFLIFE_HOURS = 24
FRESHNESS_HALFLIFE_HOURS = 48
FRESHNESS_FLOOR = 0.15
HOTNESS_SOURCE_CAP = 8
SOCIAL_FLOOR = 500.0

# --- fixed values: market weights, mood and bonuses ------------------------------------
MARKET_WEIGHTS = {"us_stock": 1.20, "crypto": 1.00, "macro_policy": 1.00, "social_signal": 0.85,
                  "general": 0.70, "hk_stock": 0.65, "jp_stock": 0.60, "kr_stock": 0.55}
MARKET_DEFAULT = 0.70
CROSS_MARKET_FLOOR = 1.0
MOOD_TIERS = ("S", "A")
MOOD_BUCKETS = [(0.50, "extreme_bullish"), (0.15, "bullish"), (-0.15, "neutral"), (-0.50, "bearish"),
                (-1.01, "extreme_bearish")]
BONUS = {"k_align": 0.25, "k_reversal": 0.20, "k_tradable": 0.06, "k_tradable_broad": 0.02, "cap": 0.50}
TRADABLE_BROAD = 5

# --- fixed values: duplicate detection --------------------------------------------------
COSINE_SAME_EVENT = 0.82
COSINE_SECTOR = 0.75
COSINE_CONTRADICTION = 0.70
TITLE_COSINE = 0.85
WINDOW_HOURS = 48
NUMBER_UNITS = {"亿": 1e8, "万": 1e4, "千": 1e3, "b": 1e9, "bn": 1e9, "billion": 1e9, "m": 1e6, "mn": 1e6,
                "million": 1e6, "k": 1e3, "thousand": 1e3}
NUMBER_PATTERN = r"(\d[\d,]*\.?\d*)\s*(亿|万|千|billion|million|thousand|bn|mn|b|m|k)?"
OUTLET_PREFIX = (r"^(blockbeats|chaincatcher|panews|odaily|foresight|marsbit|金色财经|吴说|深潮|律动|星球日报|链捕手)"
                 r"\s*(消息|讯|报道|newsflash)?\s*[,，:：]\s*")
TITLE_NOISE = (r"[\s\-—–~·|/\\_+*#@\"'`^&%$.,;:!?()\[\]{}。，、；：！？（）【】《》「」『』“”‘’…"
               r"\x{1F300}-\x{1FAFF}☀-➿]+")

# --- fixed values: percent moves in titles ----------------------------------------------
PERCENT = r"(?<!\d)(\d{1,3}(?:\.\d+)?)\s*%"
NOT_A_MOVE = (
    r"(?i)关税|税率|征税|利率|占比|比例|份额|股权|持股|概率|胜率|收益率|准备金率|"
    r"同比|环比|购金|增持|减持|持仓|净买入|净卖出|净流入|净流出|受访|通胀|"
    r"税|覆盖|超预期|不及预期|高于预期|低于预期|目标价|锁仓|持有率|收窄|"
    r"市占率|占率|市占|最大涨幅|最大跌幅|平均回报|回报率|季节性|历史均值|中位数|"
    r"tariff|tax|stake|odds|probability|yoy|y/y|qoq|"
    r"buying|purchas|holding|accumulat|inflow|outflow|year[- ]on[- ]year|"
    r"inflation|cpi|beat|miss(?:es|ed)?\s+estimate|target price|narrow|"
    r"dominance|market share|share (?:rises|falls|climbs|drops)|"
    r"seasonal|seasonality|median return|average return|all[- ]time (?:high|low)|share of")
MOVE_WORDS = (
    r"(?i)涨|跌|升|降|飙|挫|崩|泻|反弹|回调|走高|走低|翻倍|腰斩|重挫|大涨|大跌|"
    r"surge|plunge|jump|drop|fall|rise|gain|lose|rally|slump|soar|sink|"
    r"climb|tumble|spike|crash|dip|advance|decline|up|down")
EXTREME_WORDS = ["熔断", "崩盘", "暴跌", "暴涨", "涨停", "跌停", "重挫", "狂飙", "闪崩", "清零", "归零", "circuit breaker", "crash",
                 "plunge", "plummet", "soar", "surge", "collapse", "rout"]

# --- fixed values: gates ------------------------------------------------------------------
MAX_AGE_DAYS = 7
MAX_FUTURE_HOURS = 24
SEARCH_MAX_AGE_HOURS = 48
EVENT_MAX_AGE_DAYS = 5
EVENT_MAX_FUTURE_DAYS = 400
MIN_BODY_CHARS = 25
AGGREGATOR_TYPES = ("web_search",)
NON_MEDIA_TYPES = ("social", "web_search", "market_signal", "calendar")
DISABLED_SOURCES = ("BinanceSquare",)
EXCLUDED_MARKET = (r"(?i)(?<![A-Za-z])A股|沪指|沪深|上证|深证|深成指|中证\d|创业板|科创板|科创50|北证50|北交所|"
                   r"上交所|深交所|中国股市|中国股票|中国内地股|陆股(?!通)|"
                   r"chinese stocks?|china stocks?|china'?s stock market|china equit")
TOPIC_CRYPTO = (r"(?i)bitcoin|btc|ethereum|\beth\b|crypto|defi|blockchain|web3|token|stablecoin|binance|coinbase|"
                r"altcoin|nft|比特币|以太坊|加密货币|加密资产|数字货币|数字资产|区块链|币安|稳定币|链上|代币|"
                r"交易所|矿工|挖矿|狗狗币|瑞波币|马斯克币")
TOPIC_MARKET = (r"(?i)stock|equit|shares?|nasdaq|dow jones|s&p|nikkei|kospi|hang seng|federal reserve|\bfed\b|"
                r"interest rate|inflation|\bcpi\b|tariff|central bank|recession|earnings|market sell-?off|"
                r"股市|大盘|股票|美股|港股|日股|韩股|恒生|日经|纳斯达克|道琼斯|标普|美联储|利率|加息|降息|"
                r"通胀|关税|央行|经济衰退|财报")

# --- fixed values: post search ------------------------------------------------------------
MIN_ENGAGEMENT = {"security": 3, "risk": 3, "listing": 5, "whale": 5, "funding": 5, "unlock": 5,
                  "regulation": 10, "etf": 10, "breaking": 10, "market": 40, "macro": 40}
MIN_ENGAGEMENT_DEFAULT = 10
POST_SPAM = "(?i)" + "|".join([
    r"\bgiveaway\b",
    r"\b(follow|rt|retweet|like)\b[^.\n]{0,40}\b(win|enter|qualify|eligible|chance)\b",
    r"\blike\s*\+\s*(rt|retweet)\b",
    r"\btag\s+\d+\s+(friends?|people)\b",
    r"\b(drop|leave)\s+(your\s+)?(wallet|address|sol address|eth address)\b",
    r"\bclaim\s+(your\s+)?(free|airdrop|reward)\b",
    r"\bfree\s+(mint|nft|crypto|airdrop|tokens?)\b",
    r"\bjoin\s+(our|the|my)\s+(telegram|discord|group|channel|vip)\b",
    r"\bdm\s+(me|us)\b",
    r"\blink\s+in\s+bio\b",
    r"\b\d{2,4}\s*x\b[^.\n]{0,20}\b(gem|potential|incoming|soon|guaranteed)\b",
    r"\bnext\s+(100x|1000x|gem|moonshot|shiba|pepe)\b",
    r"\b(presale|pre-sale|whitelist spots?|early access)\b[^.\n]{0,30}\b(live|open|now)\b",
    r"\bguaranteed\s+(profit|returns?|gains?)\b",
    r"\bpump\s+(group|signal|call)s?\b",
    r"(私信|加群|进群|带单|喊单|内部消息|稳赚|包赚|免费领取|一对一指导)",
    r"(关注|转发)[^。\n]{0,10}(抽|送|领)",
    r"\bwhale\s+just\s+bought\s+\$[\d.]+[KM]?\s+of\s+\$\w+\s+at\s+\$[\d.]+[KM]\s+MC\b",
    r"(赋能|新范式|无锁仓|资金自由无上限)[^。\n]{0,20}(理财|挖矿|质押|收益)",
    r"解锁\s*\d+%?\s*(APY|年化)",
    r"\d{2,4}\s*倍[^。\n]{0,10}(potential|币|机会|收益)",
])
PROMO_BIO = (r"(?i)\bambassador\b.{0,80}\bambassador\b|\b(OG|KOL)\s*:\s*@\w+.{0,40}@\w+|boost\s+your\s+coin")
CJK = r"[一-鿿぀-ヿ가-힯]"

# --- fixed values: verification -------------------------------------------------------------
SOURCE_TIER_WEIGHT = {"official": 1.00, "top_media": 0.85, "established": 0.70, "secondary": 0.45,
                      "unknown": 0.25, "anonymous": 0.15}
CREDIBLE_FLOOR = 0.45
REPOST_DISCOUNT = 0.5
CORROBORATION_SATURATION = 1.2
BREAKING = (r"(?i)\bbreaking\b|\bjust in\b|\bmoments ago\b|\bminutes ago\b|快讯|突发|刚刚|最新消息|重磅")
#: What each branch of BREAKING must hold, in lower case.
BREAKING_WORDS = ("breaking", "just in", "moments ago", "minutes ago", "快讯", "突发", "刚刚", "最新消息", "重磅")
DENIAL = (
    r"(?i)\b(?:denies|denied|denying|refutes?|refuted|rebuts?|debunks?|debunked|dismisses|dismissed|disputes?|"
    r"disputed)\b[^.。;；]{0,40}?\b(?:report|reports|reporting|rumou?r|rumou?rs|claim|claims|allegation|"
    r"allegations|speculation|story|hack|breach|insolvency|bankruptcy)\b|"
    r"\bunfounded\b|\buntrue\b|\bhoax\b|\bfake news\b|\bmisinformation\b|\bno evidence\b|\bnot true\b|"
    r"\bfalse (?:claim|report|rumou?r|allegation)\b|\bsets? the record straight\b|\bno truth to\b|"
    r"\bcalls? (?:the )?(?:report|claim|rumou?r)s? false\b|"
    r"否认|辟谣|系谣言|为谣言|纯属谣言|不属实|消息不实|报道不实|传闻不实|传言不实|虚假消息|假消息|无稽之谈|"
    r"予以否认|回应传闻|并无此事|查无此事|(?:官方|发文|发布|回应|公告)澄清|澄清称|"
    r"不存在(?:被盗|漏洞|此事|该情况)")
OPPOSITE_ACTIONS = [("net_inflow", "net_outflow"), ("price_surge", "price_drop"), ("listed", "delisted"),
                    ("approved", "rejected"), ("approved", "banned"), ("launched", "shutdown")]

# --- fixed values: coins -------------------------------------------------------------------
CAP_TIERS = [(1e11, "mega"), (1e10, "large"), (1e9, "mid"), (1e8, "small")]
SYMBOL_ALIASES = {"MATIC": "POL", "XBT": "BTC", "BTCB": "BTC"}
DOMINANCE_RATIO = 5.0
PRICE_MISMATCH_RATIO = 1.5
TOKENIZED_EQUITY = r"(?i)tokenized\s+stock|bstocks|xstock|tokenized\s+share|tokenized\s+equity"
COMMODITY_SYMBOLS = ["XAUT", "PAXG", "XAGT", "KAU", "KAG"]
STABLE_SYMBOLS = ["USDT", "USDC", "DAI", "FDUSD", "TUSD", "USDP", "USDD", "PYUSD", "RLUSD", "USDE", "SUSDE",
                  "GUSD", "LUSD", "FRAX", "USD1", "EURC", "EURS"]
NOT_TICKERS = ["CEO", "CFO", "CTO", "COO", "IPO", "ETF", "SEC", "FED", "GDP", "CPI", "PCE", "FOMC", "USA", "USD",
               "EUR", "GBP", "JPY", "CNY", "AI", "API", "EPS", "ATH", "ATL", "YOY", "QOQ", "EU", "UK", "US", "UN",
               "NYSE", "NASDAQ", "AMEX", "OTC", "SPAC", "REIT", "ESG", "FDA", "DOJ", "FTC"]

# --- fixed values: sector scoring -----------------------------------------------------------
GENRE_CAP = {"EVENT": 1.0, "DATA": 1.0, "ANALYSIS": 0.85, "ROUNDUP": 0.2, "PROMO": 0.3, "PRICE_NOISE": 0.4}

# --- fixed values: market signals ------------------------------------------------------------
QUOTE_ASSET = "USDT"
LEVERAGED_SUFFIXES = ["UPUSDT", "DOWNUSDT", "BULLUSDT", "BEARUSDT"]
STABLE_BASES = ["USDC", "FDUSD", "TUSD", "BUSD", "DAI", "USDP", "USD1", "XUSD", "EURI", "AEUR", "EUR", "TRY", "BRL",
                "ARS", "JPY", "GBP", "AUD", "PLN", "RON", "ZAR", "CZK", "MXN", "COP", "UAH", "NGN", "BIDR", "IDRT",
                "RUB", "VAI", "RLUSD"]
MIN_QUOTE_VOLUME = 5_000_000
TIER1_BASES = ["BTC", "ETH"]
MAJOR_BASES = ["BTC", "ETH", "BNB", "SOL", "XRP", "DOGE", "ADA", "AVAX", "LINK", "TRX", "DOT", "LTC", "BCH", "TON",
               "SHIB", "SUI", "NEAR", "APT", "UNI", "PEPE", "HBAR", "ARB", "OP", "ATOM", "FIL", "ETC", "AAVE"]
TIER2_VOLUME, TIER3_VOLUME = 30_000_000, 10_000_000
MOVE_THRESHOLDS = {"T1": 5.0, "T2": 8.0, "T3": 15.0, "T4": 25.0}
SIGNAL_AUTHORITY = {"T1": 5, "T2": 5, "T3": 4, "T4": 3}
COOLDOWN_HOURS = {"price_move": 12.0, "level_break": 24.0, "period_extreme": 24.0, "volume_spike": 12.0,
                  "funding_extreme": 12.0, "oi_jump": 8.0, "liquidation": 4.0}
KIND_PRIORITY = {"level_break": 5, "period_extreme": 4, "liquidation": 4, "price_move": 3, "oi_jump": 2,
                 "funding_extreme": 2, "volume_spike": 1}
SIGNAL_TIER_WEIGHT = {"T1": 3.0, "T2": 2.0, "T3": 1.2, "T4": 1.0}

# --- fixed values: staging priority -----------------------------------------------------------
PRIORITY_MACRO = ["CNBC-TopNews", "CNBC-Economy", "CNBC-Investing", "CNBC-Finance", "MarketWatch", "NikkeiAsia",
                  "SCMP-GlobalEcon", "SCMP-Business", "KoreaHerald", "Reuters", "Bloomberg", "Bloomberg-Markets",
                  "Bloomberg-Economics", "Bloomberg-Technology", "Bloomberg-Politics", "Forbes-Business",
                  "WSJ-Markets", "FT-Home", "Benzinga"]
PRIORITY_CRYPTO = ["CoinDesk", "TheBlock", "吴说区块链", "BlockBeats快讯", "币安上币公告", "market_signal"]
INDEX_SYMBOLS = ["SPX", "DJI", "IXIC", "RUT", "VIX", "SPY", "QQQ", "DIA", "IWM"]
