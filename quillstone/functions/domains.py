"""Enumerated domains. Fixed values of the feed's vocabulary, in its own order."""

STATES = (
    "AL", "AK", "AZ", "AR", "CA", "CO", "CT", "DE", "FL", "GA", "HI", "ID", "IL", "IN", "IA", "KS", "KY", "LA", "ME", "MD", "MA", "MI", "MN", "MS", "MO", "MT", "NE", "NV",
    "NH", "NJ", "NM", "NY", "NC", "ND", "OH", "OK", "OR", "PA", "RI", "SC", "SD", "TN", "TX", "UT", "VT", "VA", "WA", "WV", "WI", "WY", "DC", "AS", "GU", "MP", "PR", "VI",
)
COMMITTEES = {
    "hsag": "House - Agriculture", "hsap": "House - Appropriations", "hsas": "House - Armed Services", "hsbu": "House - Budget", "hscn": "House - Climate Crisis",
    "hsvc": "House - Coronavirus Pandemic", "hsed": "House - Education & Labor", "hsif": "House - Energy & Commerce", "hsso": "House - Ethics", "hsba": "House - Financial Services",
    "hsfa": "House - Foreign Affairs", "hshm": "House - Homeland Security", "hsha": "House - House Administration", "hlig": "House - Intelligence", "hsig": "House - Intelligence (Previous)",
    "hsju": "House - Judiciary", "hsmh": "House - Modernization of Congress", "hsii": "House - Natural Resources", "hsgo": "House - Oversight and Reform", "hsru": "House - Rules",
    "hssy": "House - Science, Space and Technology", "hssm": "House - Small Business", "hszs": "House - Strategic Competition between US and CCP", "hspw": "House - Transportation & Infrastructure",
    "hsvr": "House - Veterans' Affairs", "hswm": "House - Ways & Means", "hsfd": "House - Weaponization of the Federal Government",
    "ssaf": "Senate - Agriculture, Nutrition & Forestry", "ssap": "Senate - Appropriations", "ssas": "Senate - Armed Services", "ssbk": "Senate - Banking, Housing & Urban Affairs",
    "ssbu": "Senate - Budget", "sscm": "Senate - Commerce, Science & Transportation", "sseg": "Senate - Energy & Natural Resources", "ssev": "Senate - Environment & Public Works",
    "slet": "Senate - Ethics", "ssfi": "Senate - Finance", "ssfr": "Senate - Foreign Relations", "sshr": "Senate - Health, Education, Labor & Pensions",
    "ssga": "Senate - Homeland Security & Gov. Affairs", "slia": "Senate - Indian Affairs", "slin": "Senate - Intelligence", "ssju": "Senate - Judiciary",
    "ssra": "Senate - Rules and Administration", "sssb": "Senate - Small Business & Entrepreneurship", "ssva": "Senate - Veterans' Affairs", "spag": "Senate - Aging",
    "scnc": "Senate - International Narcotics Control",
}
ASSET_TYPES = (
    "stock", "stock-option", "corporate-bond", "etf", "etn", "mutual-fund", "cryptocurrency", "pdf", "municipal-security", "non-public-stock", "other", "reit", "commodity",
    "hedge", "variable-insurance", "private-equity", "closed-end-fund", "venture", "index-fund", "government-bond", "money-market-fund", "brokered",
)
SECTORS = (
    "communication-services", "consumer-discretionary", "consumer-staples", "energy", "financials", "health-care", "industrials", "information-technology", "materials",
    "real-estate", "utilities", "other",
)
MARKET_CAPS = ("mega", "large", "mid", "small", "micro", "nano")
LABELS = ("faang", "crypto", "memestock", "spac")
TX_TYPES = ("buy", "sell", "exchange", "receive")
PARTIES, CHAMBERS, GENDERS = ("democrat", "republican", "other"), ("house", "senate"), ("female", "male")
TRADE_SIZES = ("<$1K", "$1K-$15K", "$15K-$50K", "$50K-$100K", "$100K-$250K", "$250K-$500K", "$500K-$1M", "$1M-$5M", "$5M-$25M", "$25M-$50M")
#: Employers that are none; a name that begins with one counts too.
NO_EMPLOYER = (
    "self-employed", "self employed", "retired", "not employed", "n/a", "none", "homemaker", "student", "unemployed", "information requested",
    "information requested per best efforts",
)
#: Endings of company names; one is taken off.
COMPANY_ENDINGS = (
    "information requested per best efforts", "corporation", "incorporated", "partnership", "associates", "holdings", "partners", "limited", "company", "l.l.c.", "group",
    "gmbh", "corp", "inc", "llc", "ltd", "l.p.", "plc", "n.v.", "s.a.", "co", "ag",
)
#: Exchange codes of the feed and the ending that the price source gives their tickers.
EXCHANGE_ENDINGS = {"US": "", "LN": ".L", "HK": ".HK", "SS": ".ST", "SP": ".SI", "NZ": ".NZ", "CN": ".SS", "UD": ""}
