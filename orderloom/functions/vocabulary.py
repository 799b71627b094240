"""Word lists, patterns, names and limits that results depend on.

Everything here is a default. Operators take these values as parameters.
"""

# --- Fixed values: lexicon words -------------------------------------------------
POSITIVE_WORDS = (
    "bom", "otimo", "excelente", "perfeito", "maravilhoso", "adorei", "amei",
    "recomendo", "rapido", "lindo", "bonito", "satisfeito", "gostei", "funciona",
    "obrigado", "obrigada", "parabens", "incrivel", "fantastico", "top",
    "aprovado", "sensacional", "qualidade", "boa", "otima", "ótimo", "ótima",
    "super", "melhor", "feliz", "contente", "seguro", "confiavel", "pratico",
    "eficiente", "adoramos", "chegou", "certinho", "certo", "legal", "massa",
    "show", "nota", "dez", "satisfeita", "bacana", "agradeco",
)
NEGATIVE_WORDS = (
    "ruim", "pessimo", "horrivel", "terrivel", "lixo", "decepcionado",
    "decepcionante", "atraso", "atrasado", "atrasada", "demora", "demorou",
    "defeito", "defeituoso", "quebrado", "quebrou", "estragado", "errado",
    "nao", "nunca", "reclamacao", "problema", "problemas", "fraude",
    "golpe", "falso", "falsificado", "arrependido", "arrependida",
    "devolver", "devolucao", "péssimo", "péssima", "raiva", "revoltado",
    "revoltada", "descaso", "absurdo", "inaceitavel", "faltando",
    "desapontado", "desapontada", "triste", "vergonha", "vergonhoso",
    "reclamar", "insatisfeito", "insatisfeita", "pior", "detestei",
)

# --- Fixed values: aspect patterns (matched on lower-case text) ------------------
ASPECT_PATTERNS = {
    "Delivery/Logistics": r"\b(entrega|entregar|entregue|chegou|chegar|prazo|atraso|atrasou|atrasado|atrasada|demora|demorou|demorando|correios|transportadora|frete|envio|rastreio|rastreamento|dias|semanas)\b",
    "Product Quality": r"\b(produto|qualidade|material|acabamento|defeito|defeituoso|quebrado|quebrou|estragado|danificado|ruim|pessimo|péssimo|lixo|fraco|fragil)\b",
    "Wrong/Missing Item": r"\b(errado|errada|diferente|trocado|trocada|faltando|falta|incompleto|veio\s+outro|nao\s+veio|outro\s+produto)\b",
    "Customer Service": r"\b(vendedor|loja|atendimento|contato|resposta|respondem|suporte|sac|reclamacao|resolver|solucao|estorno|reembolso|devolucao|devolver|cancelar|cancelamento)\b",
    "Packaging": r"\b(embalagem|embalar|caixa|protecao|amassado|amassada|aberto|violado|violada)\b",
    "Price/Value": r"\b(preco|preço|caro|cara|valor|barato|custo|paguei|cobrado|cobranca)\b",
    "Description Mismatch": r"\b(descricao|descrição|foto|fotos|anuncio|anúncio|propaganda|aparencia|aparência|tamanho|cor|medida|especificacao)\b",
}
NO_ASPECT = "Uncategorized"

# --- Fixed values: fraud-language patterns (matched on unaccented text) ----------
SIGNAL_PATTERNS = {
    "Counterfeit or not original": (
        r"\bfalsificad", r"\bfals[oa]s?\b", r"\bpirata", r"\breplica",
        r"nao (?:e|eh|era) original", r"\bnao original",
    ),
    "Scam or fraud": (r"\bgolpe", r"\bfraud", r"\bestelionat", r"\benganad"),
    "Stolen or cloned": (r"\broubad", r"\bclonad"),
}

# --- Fixed values: topic names ----------------------------------------------------
TOPIC_NAMES = {
    0: "Positive Shopping Experience",
    1: "Order Receipt / Delivery Problems",
    2: "Product Quality Praise",
    3: "Early Delivery Satisfaction",
    4: "General Approval / Short Praise",
    5: "Mixed Delivery + Product Feedback",
    6: "Product Expectation vs Reality",
    7: "Delivery Status / Pending Orders",
}

# --- Fixed values: category translations missing from the lookup -----------------
TRANSLATION_PATCHES = {
    "pc_gamer": "pc_gamer",
    "portateis_cozinha_e_preparadores_de_alimentos": "portable_kitchen_food_preparers",
}

# --- Fixed values: segment labels -------------------------------------------------
SEGMENTS = (
    "HIGH Risk + HIGH Exposure",
    "HIGH Risk + LOW Exposure",
    "LOW Risk + HIGH Exposure",
    "LOW Risk + LOW Exposure",
)

# --- Fixed values: scenario rates, thresholds, bins -------------------------------
IMPACT_PERCENTS = (1, 2, 5, 10, 15, 20)
CONCENTRATION_PERCENTS = (50, 80, 90)
DELAY_BINS = (-7.0, 0.0, 7.0, 14.0)
DELAY_LABELS = ("7+ days early", "0-7 days early", "1-7 days late", "8-14 days late", "15+ days late")
PRICE_BINS = (0.0, 50.0, 150.0, 500.0)
PRICE_LABELS = ("<50", "50-150", "150-500", ">500")
DELAY_FENCE_DAYS = 8.39

# --- Fixed values: state codes and names ------------------------------------------
STATE_NAMES = {
    "AC": "Acre", "AL": "Alagoas", "AP": "Amapá", "AM": "Amazonas", "BA": "Bahia", "CE": "Ceará",
    "DF": "Distrito Federal", "ES": "Espírito Santo", "GO": "Goiás", "MA": "Maranhão", "MT": "Mato Grosso",
    "MS": "Mato Grosso do Sul", "MG": "Minas Gerais", "PA": "Pará", "PB": "Paraíba", "PR": "Paraná",
    "PE": "Pernambuco", "PI": "Piauí", "RJ": "Rio de Janeiro", "RN": "Rio Grande do Norte",
    "RS": "Rio Grande do Sul", "RO": "Rondônia", "RR": "Roraima", "SC": "Santa Catarina",
    "SP": "São Paulo", "SE": "Sergipe", "TO": "Tocantins",
}

# --- Fixed values: chat words -----------------------------------------------------
GREETING_WORDS = (
    "hi", "hii", "hello", "helo", "hey", "heya", "hiya", "yo", "hola", "oi", "ola", "namaste", "namaskar",
    "greetings", "howdy", "sup", "wassup", "whats", "what's", "up", "good", "morning", "afternoon", "evening",
    "day", "there", "all", "everyone", "team", "bot", "assistant", "buddy", "friend", "dear", "sir", "madam",
    "how", "are", "you", "u", "r", "doing", "is", "it", "going", "bom", "dia", "boa", "tarde", "noite", "and",
)
THANKS_WORDS = (
    "thanks", "thank", "thx", "ty", "tq", "you", "so", "much", "a", "lot", "obrigado", "obrigada", "great",
    "awesome", "nice", "cool", "perfect", "ok", "okay", "got", "it", "helpful", "that", "was", "very", "super",
    "brilliant", "amazing", "good", "job", "appreciate", "cheers",
)
FAREWELL_WORDS = (
    "bye", "goodbye", "good", "night", "see", "you", "later", "soon", "ya", "cya", "tchau", "take", "care",
    "that's", "thats", "all", "for", "now", "today", "done", "ok", "okay", "thanks",
)
FAREWELL_CUES = ("bye", "goodbye", "see", "later", "cya", "tchau", "night", "care", "done")
CAPABILITY_PATTERNS = (
    r"^(what|which)( all)? (can|could|do) (you|u) (do|help|answer|tell)",
    r"^(who|what) are (you|u)\b",
    r"^(help|menu|options|start)$",
    r"^how (can|do) (you|u|i) (help|use)",
    r"^what (kind of |type of |sort of )?questions",
)
DOMAIN_TERMS = (
    "review", "rating", "rated", "star", "stars", "score", "sentiment", "positive", "negative", "neutral",
    "complain", "complaint", "customer", "buyer", "order", "deliver", "delivery", "late", "delay", "on time",
    "on-time", "shipping", "ship", "freight", "carrier", "price", "priced", "seller", "vendor", "store",
    "category", "categories", "product", "item", "revenue", "sales", "sale", "exposure", "risk", "money", "brl",
    "reais", "r$", "topic", "aspect", "nlp", "text", "comment", "portuguese", "language model", "xlm",
    "roberta", "transformer", "embedding", "cluster", "kmeans", "k-means", "tf-idf", "tfidf", "nmf", "sql",
    "query", "queries", "table", "duckdb", "parquet", "dataset", "data set", "the data", "this data",
    "brazil", "brazilian", "state", "city", "statistic", "correlation", "spearman", "regression", "logistic",
    "odds", "mann-whitney", "mann whitney", "kruskal", "p-value", "p value", "pvalue", "significan", "median",
    "average rating", "average score", "rate", "percentage", "trend", "monthly", "per month", "2016", "2017",
    "2018", "fraud", "scam", "counterfeit", "fake", "security", "integrity", "pentest", "penetration",
    "attack", "dashboard", "project", "analysis", "analytics", "pipeline", "stage", "methodology", "method",
    "eda", "insight", "finding", "result", "payment", "installment", "boleto", "voucher", "credit card",
    "refund", "return", "profit", "margin", "clv", "lifetime value", "prioriti", "priority", "segment",
    "act first", "scenario", "business impact", "recommend", "agreement", "accuracy", "limitation",
    "assumption", "causation", "causal", "association", "sample size", "low-n", "low n", "fingerprint",
    "sha-256", "manifest", "unhappy", "dissatisf", "satisf", "quality", "packaging", "damaged", "broken",
    "wrong item", "missing item", "description", "customer service",
)
GENERIC_WORDS = (
    "stuff", "general", "interest", "other", "others", "small", "house", "fixed",
    "games", "tools", "drinks", "music", "books", "party", "christmas", "supplies", "signaling", "security",
)
FOLLOW_UP_CUES = (
    "why", "how come", "more", "explain", "elaborate", "detail", "details", "what about", "and", "which",
    "that", "those", "this", "these", "it", "its", "them", "they", "second", "third", "first", "last",
    "other", "others", "else", "also", "too", "instead", "same", "compare", "versus", "vs", "breakdown",
    "show", "list", "top", "bottom", "example", "examples", "mean", "means", "meaning",
)
SMALL_TALK_MAX_WORDS = 7
FOLLOW_UP_MAX_WORDS = 14
HISTORY_MESSAGES = 20
MESSAGE_CHARS = 4000

# --- Fixed values: prompt-injection patterns --------------------------------------
INJECTION_PATTERNS = {
    "override instructions": r"\b(ignore|disregard|forget|override)\b.{0,40}\b(previous|prior|above|earlier|all|your|system)\b.{0,30}\b(instructions?|rules?|prompts?|directions?)\b",
    "reveal system prompt": r"\b(show|reveal|print|repeat|output|tell me)\b.{0,40}\b(system prompt|hidden (?:prompt|instructions)|your (?:instructions|rules|prompt))\b",
    "secret extraction": r"\b(api[_ -]?key|secret|password|token|credentials?|\.env)\b",
    "role hijack": r"\b(you are now|act as|pretend to be|from now on you)\b.{0,40}\b(developer|admin|dan|jailbreak|unrestricted|without (?:rules|restrictions))\b",
    "jailbreak keyword": r"\b(jailbreak|do anything now|developer mode)\b",
}

# --- Fixed values: secret shapes, path shapes, event types, limits -----------------
SECRET_PATTERNS = (
    r"\bgsk_[A-Za-z0-9]{20,}",
    r"\bAIza[0-9A-Za-z_-]{30,}",
    r"\bsk-(?:proj-|ant-)?[A-Za-z0-9]{20,}",
)
WINDOWS_PATH = r"""[A-Za-z]:[\\/](?:[^\s'"`\\/]+[\\/])*([^\s'"`\\/]*)"""
UNIX_PATH = r"""(?<![\w.])/(?:[^\s'"`/]+/)+([^\s'"`/]*)"""
HIDDEN_PATHS = (r"""[A-Za-z]:[\\/][^\s"'`]*""", r"(?<![\w.])/(?:[\w.-]+/)+[\w.-]*")
HIDDEN_PATH = "<path>"
EVENT_TYPES = (
    "sql_blocked", "sql_sandbox_denied", "rate_limited",
    "request_too_large", "prompt_injection_suspected", "integrity_mismatch",
)
EVENT_DETAIL_CHARS = 300
RECENT_EVENTS = 50
RATE_LIMITS = {
    "/api/chat": (60, 60, 64 * 1024),
    "/api/chat:ai": (10, 60, 64 * 1024),
    "/api/sql/execute": (30, 60, 16 * 1024),
}
