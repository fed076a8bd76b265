"""Word lists used by the rule operators.

Fixed values: every list below decides a result (a marker is a plain substring
of the lower-cased text unless a comment says otherwise), so lists are stated
in full and in natural order.
"""

# --- evidence extraction -------------------------------------------------
STATISTIC_UNITS = ["%", "£", "$"]
STATISTIC_WORDS = ["million", "billion", "percentage point"]
CLAIM_MARKERS = [
    "argues that", "contends that", "demonstrates that", "shows that",
    "suggests that", "indicates that", "reveals that", "confirms that",
    "this essay argues", "i argue", "we argue", "it is argued",
    "the evidence shows", "the data suggests", "findings indicate",
    "this paper contends", "i contend", "we contend",
]
PREDICTION_MARKERS = [
    "will lead to", "will result in", "is expected to", "is projected to",
    "is likely to", "will increase", "will decrease", "will reduce",
    "is forecast", "is anticipated", "we predict", "the model predicts",
]
COMMITMENT_MARKERS = [
    "we will", "we shall", "we commit", "we pledge", "we guarantee",
    "the organisation will", "the company will", "the authority will",
]
CONFIDENCE = {"citation": 0.95, "statistic": 0.85, "claim": 0.80, "prediction": 0.75, "commitment": 0.85}

# --- fallback extraction (used when nothing above matches) ---------------
FALLBACK_CLAIMS = [
    "argue", "suggest", "indicate", "shows that", "demonstrates",
    "supports the", "effective", "significant", "important", "should",
]
FALLBACK_PAREN_EVIDENCE = ["et al", "20", "found", "estimate"]
FALLBACK_EVIDENCE = ["%", "£", "$", "billion", "million"]
FALLBACK_QUANTIFIED = ["%", "£", "billion", "million", "basis point"]

# --- genre-specific extraction -------------------------------------------
ESSAY_COUNTER = [
    "however", "although", "on the other hand", "nevertheless", "despite",
    "conversely", "whereas", "yet ", "but ", "in contrast", "on the contrary",
]
ESSAY_VOCABULARY = [
    "furthermore", "consequently", "demonstrate", "implications", "significant",
    "analysis", "therefore", "moreover", "nevertheless", "notwithstanding",
    "paradigm", "hypothesis", "empirical", "methodology", "systematic",
    "facilitate", "subsequently", "considerable", "fundamental", "substantial",
]
ESSAY_COHESION_STARTS = [
    "firstly", "secondly", "thirdly", "finally", "in addition", "moreover",
    "furthermore", "in conclusion", "to summarize", "to sum up", "as a result",
    "consequently", "therefore", "thus", "hence", "for example", "for instance",
    "specifically", "in particular", "on the other hand", "in contrast",
    "similarly", "likewise", "meanwhile", "next", "then", "additionally",
]
ESSAY_VOICE = [
    "i think", "i believe", "in my opinion", "i feel", "i consider",
    "from my perspective", "in my view", "i would argue", "personally", "my view is",
]
ESSAY_SUBORDINATE = [
    "because", "although", "which", "that ", "while", "since", "unless",
    "whereas", "if ", "when ", "where ", "after ", "before ",
]
TENDER_CLAIMS = ["we have", "we deliver", "our team", "we provide", "we will", "our approach"]
TENDER_CASES = ["case study", "project:", "example:", "we delivered", "we completed"]
TENDER_STAFF_TITLES = ["Dr ", "Mr ", "Ms ", "Mrs ", "Prof "]  # case-sensitive
TENDER_COMPLIANCE = [
    "section ", "clause ", "requirement ", "as specified",
    "in accordance with", "compliant", "iso ",
]
TENDER_OUTCOMES = ["%", "reduction", "increase", "saved", "delivered", "achieved"]
POLICY_OBJECTIVES = ["objective", "aim ", "goal ", "purpose", "seeks to", "intends to"]
POLICY_PREDICTIONS = ["will result", "is expected", "projected", "forecast", "anticipated"]
POLICY_EVIDENCE = ["research", "study", "data shows", "evidence", "according to"]
POLICY_STAKEHOLDERS = ["stakeholder", "community", "public", "citizens", "affected", "vulnerable"]
POLICY_IMPLEMENTATION = ["implement", "timeline", "phase ", "by 20", "will be", "mechanism"]
CONTRACT_OBLIGATIONS = ["shall ", "must ", "agrees to", "is required to", "undertakes to"]
CONTRACT_CONDITIONS = ["if ", "upon ", "provided that", "subject to", "in the event"]
CONTRACT_DEFINITIONS = ["means ", "defined as", "shall mean"]
CONTRACT_RISKS = ["liability", "indemnif", "force majeure", "terminat", "limitation", "waiver"]

# (category, quality, relevance); vocabulary quality is 0.3 per marker, at most 1
CATEGORIES = {
    "essay": [
        ("argument_thesis", 0.6, 0.9), ("topic_sentences", 0.5, 0.7),
        ("counter_arguments", 0.7, 0.8), ("vocabulary_sophistication", None, 0.7),
        ("sentence_variety", 0.6, 0.6), ("cohesion_devices", 0.6, 0.7),
        ("personal_voice", 0.5, 0.6), ("rhetorical_devices", 0.6, 0.7),
    ],
    "tender": [
        ("claims", 0.6, 0.8), ("case_studies", 0.7, 0.9), ("named_staff", 0.7, 0.8),
        ("compliance_refs", 0.7, 0.9), ("quantified_outcomes", 0.8, 0.9),
    ],
    "policy": [
        ("objectives", 0.7, 0.9), ("predictions", 0.6, 0.8), ("evidence_base", 0.7, 0.8),
        ("stakeholder_coverage", 0.6, 0.7), ("implementation", 0.6, 0.8),
    ],
    "contract": [
        ("obligations", 0.8, 0.9), ("conditions", 0.7, 0.8),
        ("definitions", 0.7, 0.7), ("risk_clauses", 0.8, 0.9),
    ],
}
REPETITION = ("rhetorical_devices", 0.4, 0.5)
# category -> role when items become claims or evidence
CLAIM_CATEGORIES = ["argument_thesis", "claims", "objectives", "obligations"]  # verifiable if quality > 0.5
SOFT_CLAIM_CATEGORIES = ["topic_sentences", "personal_voice"]  # never verifiable
EVIDENCE_TYPES = {
    "case_studies": "case_study", "quantified_outcomes": "statistic",
    "evidence_base": "citation", "compliance_refs": "citation", "definitions": "citation",
}  # all other categories: primary_data

# --- quality checks -------------------------------------------------------
CURRENT_YEAR = 2026
WORD_MINIMUM = [  # doc types, minimum words
    (["essay"], 500), (["bid", "tender"], 1000), (["policy"], 2000),
    (["survey", "research"], 3000), (["contract", "legal"], 500),
]
WORD_MINIMUM_OTHER = 100
EXPECTED_SECTIONS = [
    (["essay"], ["introduction", "conclusion"]),
    (["policy"], ["rationale", "objective", "option", "implementation"]),
    (["bid", "tender"], ["approach", "experience", "team"]),
    (["research", "survey"], ["method", "result", "discussion"]),
]
INTRO_TITLES = ["intro", "summary", "overview"]
CONCLUSION_TITLES = ["conclu", "summary", "recommendation"]
READING_RANGE = [
    (["essay"], 10.0, 16.0), (["policy"], 12.0, 18.0),
    (["bid", "tender"], 10.0, 16.0), (["contract", "legal"], 14.0, 20.0),
]
READING_RANGE_OTHER = (8.0, 18.0)
FALLACIES = [
    ("Ad hominem", ["they are wrong because", "critics fail to", "opponents are"]),
    ("Appeal to authority", ["experts agree", "studies show", "it is well known", "everyone knows"]),
    ("False dichotomy", ["either we", "the only option", "we must choose between", "there are only two"]),
    ("Slippery slope", ["inevitably", "will lead to", "slippery slope", "domino effect", "if we allow"]),
    ("Hasty generalisation", ["all of them", "every single", "always without exception", "never once"]),
    ("Straw man", ["some people foolishly claim", "opponents naively believe"]),
    ("Circular reasoning", ["this is true because it is true", "as we already proved"]),
]
HEDGES = [
    "might", "could", "perhaps", "possibly", "seems", "appears", "suggests",
    "may", "arguably", "potentially", "likely",
]
STRONG_ASSERTIONS = [
    "clearly", "obviously", "undoubtedly", "certainly", "proves",
    "demonstrates conclusively", "without question", "undeniably", "irrefutably",
]
COUNTER_MARKERS = [
    "however", "on the other hand", "critics argue", "alternatively",
    "despite this", "conversely", "nevertheless", "opponents suggest",
    "a counter-argument", "it could be objected", "some may argue",
    "an alternative view",
]
TRANSITIONS = [
    "furthermore", "moreover", "additionally", "in addition", "however",
    "nevertheless", "although", "despite", "therefore", "consequently",
    "as a result", "because", "firstly", "secondly", "finally", "subsequently",
    "similarly", "likewise", "in contrast", "conversely", "building on",
    "turning to", "having established", "this section", "the following", "as discussed",
]
VAGUE_TERMS = [  # whole words (ASCII alphanumeric neighbours disqualify)
    "things", "stuff", "aspects", "various", "a number of", "several",
    "a lot of", "good", "bad", "interesting", "important", "significant",
    "nice", "great",
]
FOOTNOTE_MARKS = "¹²³⁴⁵⁶⁷⁸⁹"

# --- predictions -----------------------------------------------------------
PAST_MARKERS = [  # whole words
    "increased", "decreased", "was", "were", "showed", "found", "demonstrated",
    "revealed", "rose", "fell", "dropped", "grew", "declined", "surged",
    "doubled", "tripled", "halved", "experienced", "recorded", "reported", "observed",
]
FUTURE_MARKERS = ["will ", "shall ", "aims to", "plan to", "is expected to", "is projected to"]
TARGET_WORDS = [
    "reduce", "increase", "achieve", "improve by", "grow by", "decrease",
    "cut by", "raise to", "target of", "goal of",
]
TARGET_UNITS = ["%", "£", "$"]
COST_WORDS = ["estimated", "cost of", "budget of", "investment of", "£", "$"]
COST_SIZES = ["million", "billion", "£", "$"]
COST_PERIODS = ["over", "per year", "annual"]
TIMELINE_WORDS = [
    "within", "by march", "by april", "by may", "by june", "by july",
    "by august", "by september", "by october", "by november", "by december",
    "by january", "by february", "by 20", "months", "phase 1", "phase 2", "phase 3",
]
TIMELINE_ACTIONS = ["will", "shall", "plan to", "aim to", "deliver"]
COMPARISON_WORDS = [
    "achieves", "compared to", "better than", "worse than", "more effective",
    "less effective", "outperforms", "% of the",
]
GOAL_WORDS = [
    "will improve", "will enhance", "aims to", "seeks to", "will ensure",
    "will establish", "will create", "will develop",
]
PLEDGE_WORDS = ["we will", "we commit", "we pledge", "we guarantee", "we shall"]
BY_STARTS = [
    "march", "april", "may", "june", "july", "august", "september", "october",
    "november", "december", "january", "february", "20", "the end of", "end of",
    "q1", "q2", "q3", "q4",
]

# --- keyword stop lists ------------------------------------------------------
STOP_ALIGN = [
    "the", "a", "an", "and", "or", "of", "in", "on", "at", "to", "for", "is",
    "are", "was", "were", "be", "been", "being", "have", "has", "had", "do",
    "does", "did", "will", "would", "could", "should", "may", "might", "shall",
    "can", "this", "that", "these", "those", "with", "from", "by", "as", "it",
    "its", "not", "no", "but", "if", "than", "so", "very", "all", "each",
    "every", "any", "some", "such", "only", "also", "how", "what", "which",
    "who", "whom", "when", "where", "why",
]
STOP_PREDICT = [
    "the", "a", "an", "and", "or", "of", "in", "on", "to", "for", "is", "are",
    "was", "were", "be", "will", "would", "could", "should", "may", "might",
    "this", "that", "with", "from", "by", "as", "it", "not",
]
STOP_FLOW = [
    "about", "above", "after", "again", "against", "along", "among", "around",
    "because", "before", "being", "below", "between", "beyond", "could",
    "would", "should", "these", "those", "their", "there", "through", "under",
    "until", "which", "while", "where", "other", "another", "every", "further",
    "having", "itself", "might", "since", "still", "than", "that", "them",
    "then", "this", "very", "what", "when", "with", "within", "without",
    "also", "been", "does", "from", "have", "here", "into", "just", "more",
    "most", "much", "must", "only", "over", "same", "some", "such", "will", "your",
]

# --- text quality signal ---------------------------------------------------
EVIDENCE_WORDS = [
    "evidence", "data", "study", "research", "survey", "report", "analysis",
    "finding", "result", "outcome", "demonstrated", "measured", "achieved",
    "improved", "reduced", "increased",
]

# --- graph from scored nodes -----------------------------------------------
NODE_EVIDENCE_WORDS = ["evidence", "statistic", "data", "citation", "quote"]
NODE_QUANTIFIED_WORDS = ["statistic", "quantif", "number"]
NODE_CITATION_WORDS = ["citation", "quote", "reference"]
NODE_CLOSING_WORDS = ["conclusion", "closing"]

# --- claim verification ------------------------------------------------------
NAME_STOP_CITATION = ["The", "This", "That", "Our", "We", "In", "For", "And", "But"]
NAME_STOP_ENTITY = ["The", "This", "That", "Our", "We", "In", "For", "And", "But", "A"]

# --- lots --------------------------------------------------------------------
SHARED_PATTERNS = [
    "shared", "common", "itt", "t&c", "t_c", "t-c", "terms and conditions",
    "terms_and_conditions", "specification", "spec", "instructions", "guidance",
    "general", "overview", "background", "contract notice",
    "selection questionnaire", "sqd", "pqq", "framework", "pricing schedule",
    "form of tender",
]
TEXT_EXTENSIONS = ["pdf", "docx", "md", "txt"]

# --- prompt threats: class, severity, patterns (default lexicon) ---------------
THREATS = [
    ("DirectOverride", "critical", [
        "ignore all", "ignore previous", "forget everything", "forget all instructions",
        "disregard all", "new instructions", "vergiss alles", "oubliez tout", "olvide todo"]),
    ("RoleInjection", "high", [
        "you are now", "act as", "pretend to be", "pretend you are", "from now on you", "roleplay as"]),
    ("JailbreakPersona", "critical", [
        "dan mode", "developer mode", "jailbreak", "god mode", "sudo mode", "unrestricted mode"]),
    ("ForcedResponse", "high", [
        "only say", "only respond", "you must say", "always respond", "say that you"]),
    ("ScoreManipulation", "critical", [
        "score this 10", "score =", "rate this highly", "maximum score", "perfect score"]),
    ("PromptExtraction", "critical", [
        "show your prompt", "reveal your instructions", "what is your system prompt",
        "print your instructions"]),
    ("DelimiterEscape", "critical", [
        "[system:", "[inst]", "<<sys>>", "<|im_start|>", "### instruction"]),
    ("HiddenDirective", "critical", ["<!--", "eval_override", "$documents:"]),
    ("AuthorityImpersonation", "high", [
        "i am your developer", "i work at openai", "i work at anthropic", "i am an admin"]),
    ("WeaponInstructions", "critical", [
        "how to make a bomb", "how to make a weapon", "build an explosive", "make poison"]),
    ("CyberAttackInstructions", "critical", [
        "write malware", "hack into", "ddos attack", "write an exploit", "ransomware"]),
]
SEVERITY_ORDER = ["critical", "high", "medium", "low"]

# --- intent routing: ordered (target, keywords); first hit wins ------------------
DOMAIN_ROUTES = [
    ("academic", ["essay", "mark", "thesis", "coursework", "assignment", "grade", "dissertation"]),
    ("tender", ["bid", "tender", "proposal", "itt", "procurement", "score"]),
    ("policy", ["policy", "strategy", "impact", "assessment"]),
    ("survey", ["survey", "research", "methodology", "questionnaire"]),
    ("legal", ["contract", "legal", "compliance", "terms"]),
    ("clinical", ["nhs", "clinical", "governance", "patient"]),
]
FRAMEWORK_ROUTES = [
    ("policy_greenbook", ["green book", "impact assessment"]),
    ("survey_methodology", ["survey", "methodology", "questionnaire"]),
    ("contract_review", ["contract", "legal"]),
    ("ellipse_ell", ["ellipse", "english learner", "ell ", "language proficiency"]),
    ("gcse_english", ["gcse", "english language"]),
    ("nhs_clinical_governance", ["nhs", "clinical", "governance"]),
    ("academic_essay", ["essay", "mark", "a-level", "coursework"]),
]
GENRE_ROUTES = [
    ("essay", ["essay", "grade", "mark", "language", "writing"]),
    ("tender", ["tender", "bid", "proposal", "rfp"]),
    ("policy", ["policy", "legislation", "regulation", "white paper"]),
    ("contract", ["contract", "agreement", "terms", "legal"]),
]
SECTOR_ROUTES = [  # not exclusive: an intent may fall in several sectors
    ("education", ["essay", "mark", "grade", "coursework", "assignment", "a-level", "gcse",
                   "education", "school", "ofsted", "teaching", "curriculum", "student"]),
    ("healthcare", ["nhs", "clinical", "health", "patient", "care", "medical", "nursing",
                    "hospital", "cqc"]),
    ("government", ["policy", "government", "green book", "impact assessment", "public sector",
                    "civil service", "whitehall", "legislation", "regulation", "strategy", "cabinet"]),
    ("legal", ["contract", "legal", "law", "compliance", "gdpr", "terms", "agreement",
               "licence", "liability"]),
    ("research", ["survey", "research", "methodology", "questionnaire", "study",
                  "data collection", "sample"]),
]
