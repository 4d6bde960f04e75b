"""Word lists and tables that decide results. All are fixed values."""

from __future__ import annotations

#: Fixed values: (channel, keyword, weight) for story titles. 3 names, 2 jargon and phrases, 1 generic words.
STORY_KEYWORDS = [
    ("ai", "gpt", 3.0), ("ai", "llm", 3.0), ("ai", "openai", 3.0), ("ai", "chatgpt", 3.0), ("ai", "anthropic", 3.0),
    ("ai", "mistral", 3.0), ("ai", "llama", 3.0), ("ai", "gemini", 3.0), ("ai", "claude", 3.0), ("ai", "rlhf", 3.0),
    ("ai", "machine learning", 2.0), ("ai", "deep learning", 2.0), ("ai", "neural network", 2.0), ("ai", "fine-tuning", 2.0), ("ai", "foundation model", 2.0),
    ("ai", "neural", 1.0), ("ai", "ai", 1.0),
    ("security", "ransomware", 3.0), ("security", "malware", 3.0), ("security", "cve", 3.0), ("security", "zero-day", 3.0),
    ("security", "cybersecurity", 2.0), ("security", "vulnerability", 2.0), ("security", "phishing", 2.0), ("security", "exploit", 2.0),
    ("security", "breach", 1.0), ("security", "hack", 1.0), ("security", "security", 1.0),
    ("startup", "series a", 3.0), ("startup", "series b", 3.0), ("startup", "series c", 3.0), ("startup", "ipo", 3.0),
    ("startup", "acquisition", 2.0), ("startup", "acquired", 2.0), ("startup", "venture capital", 2.0), ("startup", "valuation", 2.0),
    ("startup", "funding", 1.0), ("startup", "startup", 1.0), ("startup", "seed", 1.0),
    ("crypto", "bitcoin", 3.0), ("crypto", "ethereum", 3.0), ("crypto", "solana", 3.0), ("crypto", "binance", 3.0), ("crypto", "coinbase", 3.0),
    ("crypto", "blockchain", 2.0), ("crypto", "defi", 2.0), ("crypto", "web3", 2.0), ("crypto", "nft", 2.0), ("crypto", "crypto", 1.0),
    ("science", "arxiv", 3.0), ("science", "crispr", 3.0), ("science", "genomics", 3.0),
    ("science", "nasa", 3.0), ("science", "blue origin", 3.0), ("science", "new glenn", 3.0), ("science", "starship", 3.0),
    ("science", "rocket", 2.0), ("science", "orbital", 2.0), ("science", "aerospace", 2.0), ("science", "booster", 2.0), ("science", "spacex", 1.0),
    ("science", "physics", 2.0), ("science", "biology", 2.0), ("science", "chemistry", 2.0), ("science", "climate", 2.0), ("science", "journal", 2.0),
    ("science", "discovery", 1.0), ("science", "research", 1.0), ("science", "study", 1.0), ("science", "paper", 1.0), ("science", "space", 1.0), ("science", "launch", 1.0),
    ("tech", "nvidia", 3.0), ("tech", "amd", 3.0), ("tech", "apple", 3.0), ("tech", "google", 3.0), ("tech", "microsoft", 3.0), ("tech", "amazon", 3.0), ("tech", "meta", 3.0),
    ("tech", "home assistant", 2.0), ("tech", "sqlite", 2.0), ("tech", "postgres", 2.0), ("tech", "oauth", 2.0), ("tech", "gpu", 2.0), ("tech", "chip", 2.0), ("tech", "hardware", 2.0),
    ("tech", "database", 1.0), ("tech", "software", 1.0), ("tech", "laptop", 1.0), ("tech", "open source", 1.0),
    ("policy", "gdpr", 3.0), ("policy", "antitrust", 3.0), ("policy", "sec", 3.0), ("policy", "congress", 3.0), ("policy", "senate", 3.0),
    ("policy", "regulation", 2.0), ("policy", "court", 2.0), ("policy", "government", 2.0), ("policy", "election", 2.0),
    ("policy", "law", 1.0), ("policy", "policy", 1.0), ("policy", "ban", 1.0),
]

#: Fixed values: (domain, channel, boost) for stories.
STORY_BOOSTS = [
    ("github.com", "tech", 2.0), ("arxiv.org", "science", 3.0), ("techcrunch.com", "startup", 2.0), ("sec.gov", "policy", 3.0), ("reuters.com", "policy", 1.0), ("bloomberg.com", "startup", 1.0),
    ("wired.com", "tech", 1.0), ("arstechnica.com", "tech", 1.0), ("theregister.com", "security", 2.0), ("krebsonsecurity.com", "security", 3.0), ("coindesk.com", "crypto", 3.0),
    ("nature.com", "science", 3.0), ("science.org", "science", 3.0), ("nasa.gov", "science", 3.0), ("space.com", "science", 2.0), ("spacenews.com", "science", 2.0),
]

#: Channels from first to last in a tie; the last is for what no channel claims.
STORY_PRIORITY = ["ai", "security", "crypto", "startup", "policy", "science", "tech", "general"]

#: Keywords whose inflected forms count too, of stories and of posts.
STORY_ROOTS = {"hack", "breach", "exploit", "llm", "foundation model"}
POST_ROOTS = {"hack", "breach", "exploit", "leak", "protest", "artfight", "strike", "union"}

#: Fixed values for posts: (domain, channel, boost).
POST_BOOSTS = [
    ("apnews.com", "war_diplomacy", 3.0), ("bbc.com", "war_diplomacy", 2.0), ("reuters.com", "war_diplomacy", 2.0), ("theguardian.com", "war_diplomacy", 2.0), ("nytimes.com", "war_diplomacy", 2.0),
    ("aljazeera.com", "war_diplomacy", 3.0), ("smh.com.au", "war_diplomacy", 2.0), ("abc.net.au", "war_diplomacy", 2.0), ("abc7.com", "war_diplomacy", 1.0), ("nation.cymru", "war_diplomacy", 2.0),
    ("bbc.co.uk", "war_diplomacy", 2.0), ("europesays.com", "war_diplomacy", 1.0), ("msn.com", "war_diplomacy", 1.0),
    ("washingtonpost.com", "us_politics", 2.0), ("politico.com", "us_politics", 3.0), ("thehill.com", "us_politics", 2.0), ("salon.com", "us_politics", 2.0), ("laprogressive.com", "us_politics", 2.0),
    ("krebsonsecurity.com", "cybersecurity", 3.0), ("theregister.com", "cybersecurity", 2.0), ("wired.com", "cybersecurity", 1.0),
    ("arxiv.org", "science_space", 3.0), ("nature.com", "science_space", 3.0), ("science.org", "science_space", 3.0), ("nasa.gov", "science_space", 3.0),
    ("pubmed.ncbi.nlm.nih.gov", "health_medicine", 3.0),
    ("spc.noaa.gov", "climate_weather", 3.0), ("weather.gov", "climate_weather", 2.0), ("wpc.ncep.noaa.gov", "climate_weather", 2.0), ("mesonet.agron.iastate.edu", "climate_weather", 2.0),
    ("coindesk.com", "money_markets", 3.0), ("bloomberg.com", "money_markets", 2.0), ("wsj.com", "money_markets", 2.0), ("ft.com", "money_markets", 2.0),
    ("github.com", "ai_tech", 2.0), ("techcrunch.com", "ai_tech", 2.0), ("arstechnica.com", "ai_tech", 2.0), ("thedrive.com", "ai_tech", 1.0),
    ("youtu.be", "entertainment_fandom", 2.0), ("youtube.com", "entertainment_fandom", 2.0), ("open.spotify.com", "entertainment_fandom", 2.0), ("ign.com", "entertainment_fandom", 3.0),
    ("variety.com", "entertainment_fandom", 2.0), ("rollingstone.com", "entertainment_fandom", 2.0), ("berlinartlink.com", "entertainment_fandom", 2.0), ("ko-fi.com", "entertainment_fandom", 2.0),
    ("artfight.net", "entertainment_fandom", 3.0), ("archiveofourown.org", "entertainment_fandom", 3.0), ("store.steampowered.com", "entertainment_fandom", 3.0),
    ("niemanlab.org", "social_platforms", 2.0), ("poynter.org", "social_platforms", 2.0),
    ("transfermarkt.com", "sports", 3.0),
]

#: Fixed values for posts: channels from first to last in a tie, least scores, weights.
POST_PRIORITY = [
    "cybersecurity", "ai_tech", "war_diplomacy", "us_politics", "activism_rights", "climate_weather", "health_medicine",
    "science_space", "money_markets", "social_platforms", "sports", "entertainment_fandom", "general",
]
LEAST_SCORES = {"social_platforms": 2.0}
HASHTAG_WEIGHT, GATED_WEIGHT = 1.5, 0.25

#: Per channel weak keywords, and strong terms without which they count a quarter.
CONTEXT_GATES = {
    "cybersecurity": (
        ["exploit", "security", "hack", "attack", "threat", "breach"],
        ["cve", "zero-day", "ransomware", "malware", "phishing", "vulnerability", "nsa", "cisa", "fbi", "apt", "backdoor", "spyware", "trojan", "rootkit", "keylogger", "botnet"],
    ),
    "science_space": (
        ["science", "research", "study", "discovery", "space"],
        ["nasa", "spacex", "arxiv", "esa", "telescope", "galaxy", "black hole", "biorxiv", "medrxiv", "jwst", "asteroid", "neutron", "quasar", "exoplanet", "hubble", "rocket"],
    ),
    "health_medicine": (
        ["health", "medicine", "medical", "doctor", "hospital"],
        ["fda", "cdc", "who", "nih", "vaccine", "clinical", "pandemic", "outbreak", "treatment", "diagnosis", "pathogen", "trial", "pharmaceutical", "mortality"],
    ),
}

#: Domains that feed a channel with papers.
FEED_DOMAINS = {"science_space": ["arxiv.org", "biorxiv.org", "medrxiv.org"]}

#: Hashtag and the words it stands for.
HASHTAG_ALIASES = {
    "wx": "weather noaa forecast",
    "f1": "formula 1 motorsport racing",
    "oc": "original character art creator",
    "nowplaying": "music song album artist",
    "booksky": "book reading author",
    "worldcup": "world cup soccer sports",
    "loveislandusa": "reality tv show entertainment",
    "loveisland": "reality tv show entertainment",
    "gamedev": "game developer creator",
    "indiedev": "game developer creator",
    "indiegame": "game developer creator",
    "usmnt": "soccer team sports",
    "resist": "protest activism movement rights",
}

#: Authors and phrases of automated posts.
BOT_AUTHORS = ["AutoModerator", "reddit", "BotDefense", "RepostSleuthBot", "RemindMeBot", "sneakpeek_bot", "reddit-stream", "dang", "pg"]
BOILERPLATE = [
    "i am a bot, and this action was performed automatically",
    "your submission has been removed",
    "please contact the moderators of this subreddit",
    "this is a reminder to",
    "^i ^am ^a ^bot",
    "this item has been flagged",
]

#: Hashtags, words and signs of posts to drop.
ADULT_HASHTAGS = "nsfw porn nude naked xxx gayporn onlyfans fansly 18+ adult horny nudes explicit findom femdom paypig finsub".split()
ROUTINE_HASHTAGS = "wordle connections nytgames worldle quordle starbattle".split()
ROUTINE_WORDS = r"(?i)\b(wordle|connections|quordle|worldle|daily puzzle|nyt games)\b"
ROUTINE_GRID = "[⬜🟨🟩⬛🟥🟦]{4,}"
NOT_PROSE = r"(?i)https?://\S+|@\w+|#\w+"
BODY_URL = r"(?i)https?://[^\s<>\"')]+|(?<!\w)(?:youtu\.be|bit\.ly|t\.co|tinyurl\.com|open\.spotify\.com)/\S+"

#: Words that are never a cluster's keyword.
STOPWORDS = set(
    """
    the a an and or but in on at to for of with is it this that was are be have has had do does did will would could should
    i you he she we they my your its their not no so if as up out just like get got can all one been from by about more
    what when how who which there they them
    lol lmao omg wtf wow omfg bruh bro dude haha hehe nah yep yup yeah damn hell fuck shit crap ngl imo tbh btw fyi iirc
    him her his why only even than see now most use very still then here any been being these other
    didn don won isn wasn doesn wouldn couldn hadn shouldn
    people think work years year good make time thing things way want need know going sure lot though however well
    really actually also some many much bit find through because something same point run article writing write read video
    https http www com org net html utm amp delayed deleted highest setting relocate willing technologies
    """.split()
)

#: Further words left out where a window has one cluster only.
LONE_CLUSTER_STOPWORDS = STOPWORDS | set(
    """
    really actually pretty quite still already never always maybe probably literally very looks wait man guy yeah good bad great
    thing things someone anyone everyone anything want need know make take give look come think say use try keep let feel seem
    removed submission compose moderator subreddit thread edit update deleted see also much delayed highest setting
    https http www com org net html utm amp relocate willing technologies
    """.split()
)

#: Keywords that do not count in matching, and those not displayed either.
NOISE_KEYWORDS = """
into onto over also just even well here only then when what where back too more some such both very like said does will
would could have been were from with them they this that
""".split()
HIDDEN_KEYWORDS = [*NOISE_KEYWORDS, *"using new better show first maybe those always part".split()]

#: Further words that reports leave out.
REPORT_NOISE = [
    *HIDDEN_KEYWORDS,
    *"""
    there their about after say says every right used never true clear great few old waiting really think know want going make
    many good need look take people time year years way nap fish working write wrote still already actually though without
    should much most made another same while until across under between each saying yes please keep agree idea comment past
    seem seems getting add call calls something someone everything nothing anything exactly might happen happens happened since
    again done being doing thing things
    """.split(),
]
TITLE_STOPWORDS = """
the a an and or but in on at to for of with by is are was were be been being have has had do does did will would could should
may might can not no nor if as that this it its from into now get let ask how who what when where why which about after new using
""".split()

#: Words of hiring templates, and titles of threads that recur.
HIRING_WORDS = "remote location yes full engineer python willing relocate senior stack hybrid onsite visa salary".split()
RECURRING_TITLES = ["who is hiring", "who wants to be hired", "what are you working on"]

#: Words left out, stemmed, when channels are compared.
CROSS_CHANNEL_STOPWORDS = """
people don because please good https www com reddit message post questions audio some think his were time comment comments karma
upvote downvote thread moderator subreddit submission compose removed likes views million broken really looks wait man also much
people person game play year new content thank unfortunately deleted following reason per hey scope limit rule
jpeg pjpg webp width format gif giphy redd auto preview
""".split()
