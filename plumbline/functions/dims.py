"""Built-in dimension tables: evaluation frameworks, evaluator panels, guidelines.

Fixed values; each table is small by definition and never grows with the data.
Rubric wording is not built in: ``sources.read_framework`` reads it per framework.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# framework_id: (name, total_weight, pass_mark, [(criterion_id, title, description, max_score, weight)])
FRAMEWORKS = {
    "generic_quality": ("Generic Quality Framework", 1.0, 5.0, [
        ("clarity_structure", "Clarity & Structure", "Logical organisation, clear writing, effective use of headings and formatting", 10.0, 0.15),
        ("evidence_specificity", "Evidence & Specificity", "Use of concrete examples, case studies, data, and quantified outcomes", 10.0, 0.20),
        ("technical_depth", "Technical Depth", "Demonstrates deep domain knowledge and sound methodology", 10.0, 0.20),
        ("feasibility_risk", "Feasibility & Risk", "Realistic planning, risk identification and mitigation strategies", 10.0, 0.15),
        ("value_for_money", "Value for Money", "Cost-effectiveness, efficient resource allocation, clear pricing rationale", 10.0, 0.15),
        ("social_value", "Social Value", "Community benefit, sustainability, diversity and inclusion commitments", 10.0, 0.10),
        ("compliance", "Compliance", "Adherence to specification requirements, completeness of response", 10.0, 0.05),
    ]),
    "academic_essay": ("Academic Essay Marking Framework", 1.0, 4.0, [
        ("knowledge_understanding", "Knowledge & Understanding", "Demonstrates comprehensive knowledge of the subject matter and key concepts", 8.0, 0.25),
        ("analysis_evaluation", "Analysis & Evaluation", "Critical analysis, evaluation of arguments, and synthesis of ideas", 12.0, 0.30),
        ("application", "Application", "Application of theory to practice, use of examples and real-world contexts", 8.0, 0.20),
        ("communication_structure", "Communication & Structure", "Clarity of expression, logical structure, academic writing conventions", 6.0, 0.15),
        ("use_of_sources", "Use of Sources", "Range and quality of sources, correct referencing and citation", 6.0, 0.10),
    ]),
    "ellipse_ell": ("ELLIPSE English Language Proficiency", 1.002, 2.5, [
        ("cohesion", "Cohesion", "How well ideas connect through transitions and logical flow between sentences and paragraphs", 5.0, 0.167),
        ("syntax", "Syntax", "Sentence structure variety and correctness — simple vs complex sentences, subordination, coordination", 5.0, 0.167),
        ("vocabulary", "Vocabulary", "Range and precision of word choice — academic vs basic vocabulary, word form accuracy", 5.0, 0.167),
        ("phraseology", "Phraseology", "Natural phrasing, idiom use, collocations — does the writing sound natural to a native reader?", 5.0, 0.167),
        ("grammar", "Grammar", "Grammatical accuracy — subject-verb agreement, tense consistency, articles, prepositions", 5.0, 0.167),
        ("conventions", "Conventions", "Spelling, punctuation, capitalisation accuracy", 5.0, 0.167),
    ]),
    "policy_greenbook": ("HM Treasury Green Book Impact Assessment", 1.0, 60.0, [
        ("rationale_objectives", "Rationale & Objectives", "Is the rationale clear? Are SMART objectives defined?", 10.0, 0.20),
        ("evidence_base", "Evidence Base", "Quality and recency of evidence cited", 10.0, 0.20),
        ("options_appraisal", "Options Appraisal", "Are alternatives properly considered?", 10.0, 0.15),
        ("stakeholder_engagement", "Stakeholder Engagement", "Are affected communities represented?", 10.0, 0.15),
        ("value_for_money_greenbook", "Value for Money", "Is the cost-benefit analysis sound?", 10.0, 0.15),
        ("delivery_implementation", "Delivery & Implementation", "Is the plan feasible and realistic?", 10.0, 0.15),
    ]),
    "survey_methodology": ("Research Survey Quality Framework", 1.0, 50.0, [
        ("sampling_design", "Sampling Design", "Representative, adequate size, appropriate method", 10.0, 0.20),
        ("question_design", "Question Design", "Clear, unbiased, valid, reliable", 10.0, 0.20),
        ("data_collection", "Data Collection", "Consistent procedures, response rates", 10.0, 0.15),
        ("analysis_methods", "Analysis Methods", "Appropriate statistics, significance testing", 10.0, 0.20),
        ("ethics_consent", "Ethics & Consent", "Informed consent, data protection, anonymisation", 10.0, 0.10),
        ("reporting", "Reporting", "Limitations acknowledged, findings clearly presented", 10.0, 0.15),
    ]),
    "contract_review": ("Legal Contract Assessment Framework", 1.0, 60.0, [
        ("clarity_of_terms", "Clarity of Terms", "Definitions, unambiguous language", 10.0, 0.15),
        ("obligations_deliverables", "Obligations & Deliverables", "Clear scope, milestones, acceptance criteria", 10.0, 0.20),
        ("risk_allocation", "Risk Allocation", "Liability, indemnities, force majeure", 10.0, 0.20),
        ("commercial_terms", "Commercial Terms", "Pricing, payment, penalties", 10.0, 0.15),
        ("regulatory_compliance", "Regulatory Compliance", "GDPR, sector-specific regulations", 10.0, 0.15),
        ("termination_dispute", "Termination & Dispute", "Exit clauses, dispute resolution", 10.0, 0.15),
    ]),
    "gcse_english": ("GCSE English Language Marking Framework", 1.0, 40.0, [
        ("content_ideas", "Content & Ideas", "Engaging content, original ideas, deliberate choices", 24.0, 0.25),
        ("organisation", "Organisation", "Structure, paragraphing, cohesion, discourse markers", 24.0, 0.25),
        ("vocabulary_sentence_structure", "Vocabulary & Sentence Structure", "Range, effectiveness, variety", 24.0, 0.25),
        ("technical_accuracy", "Technical Accuracy", "Spelling, punctuation, grammar", 16.0, 0.25),
    ]),
    "nhs_clinical_governance": ("NHS Clinical Governance Assessment Framework", 1.0, 65.0, [
        ("patient_safety", "Patient Safety", "Risk management, incident reporting, safeguarding", 10.0, 0.25),
        ("clinical_effectiveness", "Clinical Effectiveness", "Evidence-based practice, audit, outcomes", 10.0, 0.20),
        ("patient_experience", "Patient Experience", "Feedback mechanisms, complaints handling, dignity", 10.0, 0.20),
        ("staff_management", "Staff Management", "Training, supervision, workforce planning", 10.0, 0.15),
        ("information_governance", "Information Governance", "Data security, confidentiality, record keeping", 10.0, 0.10),
        ("leadership_accountability", "Leadership & Accountability", "Governance structures, transparency", 10.0, 0.10),
    ]),
    "technical_documentation": ("Technical Documentation Framework", 1.0, 5.0, [
        ("clarity_structure", "Clarity & Structure", "Logical organisation, clear headings, progressive disclosure of complexity", 10.0, 0.20),
        ("evidence_benchmarks", "Evidence & Benchmarks", "Quantified claims backed by reproducible benchmarks, specific numbers, and test results", 10.0, 0.25),
        ("technical_depth", "Technical Depth", "Demonstrates deep understanding of the domain, architecture decisions justified", 10.0, 0.20),
        ("completeness", "Completeness", "All necessary sections present: installation, usage, API, examples, limitations", 10.0, 0.15),
        ("examples_usage", "Examples & Usage", "Working code examples, clear usage instructions, real output shown", 10.0, 0.10),
        ("honesty_limitations", "Honesty & Limitations", "Acknowledges what doesn't work, presents honest benchmarks, discusses limitations", 10.0, 0.10),
    ]),
}

MODERATOR = ("Dr. Carla Mendez", "Panel Moderator", "Evaluation Moderation")
PANELS = {  # domain: [(name, role, expertise)]; the moderator joins every panel
    "academic": [
        ("Prof. Eleanor Harding", "Subject Expert", "Academic Subject Matter"),
        ("Dr. Marcus Chen", "Academic Writing Specialist", "Academic Writing"),
        ("Dr. Amira Osei", "Critical Thinking Assessor", "Critical Analysis"),
    ],
    "tender": [
        ("Sarah Mitchell", "Procurement Lead", "Procurement & Compliance"),
        ("Dr. James Okonkwo", "Domain Expert", "Technical Delivery"),
        ("Priya Sharma", "Social Value Champion", "Social Value & Sustainability"),
        ("Robert Tanaka", "Finance Assessor", "Financial Analysis"),
    ],
    "policy": [
        ("Dr. Helena Voss", "Policy Analyst", "Policy Analysis"),
        ("Maria Santos", "Stakeholder Representative", "Community & Stakeholder Engagement"),
        ("Tom Brennan", "Implementation Expert", "Programme Delivery"),
    ],
    "survey": [
        ("Prof. Yuki Nakamura", "Statistician", "Statistical Methods"),
        ("Dr. Fiona Adebayo", "Domain Expert", "Research Design"),
        ("Dr. Isaac Lowe", "Ethics Reviewer", "Research Ethics"),
    ],
    "legal": [
        ("Catherine Park", "Legal Reviewer", "Legal Analysis"),
        ("David Okoye", "Compliance Officer", "Regulatory Compliance"),
        ("Laura Fleming", "Commercial Analyst", "Commercial Terms"),
    ],
    "clinical": [
        ("Dr. Helen Cartwright", "Clinical Governance Lead", "Patient Safety & Governance"),
        ("Prof. Rajan Mehta", "Clinical Effectiveness Reviewer", "Evidence-Based Practice"),
        ("Janet Okafor", "Patient Experience Advocate", "Patient Voice & Complaints"),
    ],
    "generic": [
        ("Dr. Rachel Kim", "Quality Assessor", "Quality Evaluation"),
        ("Dr. Samuel Grant", "Evidence Reviewer", "Evidence Assessment"),
        ("Prof. Nadia Petrova", "Domain Expert", "Subject Matter Expertise"),
    ],
}
TRUST_FROM_MODERATOR, TRUST_FROM_MEMBER = 0.6, 0.5

# title, source, sector, relevance, key criteria
GUIDELINES = [
    ("Ofsted Education Inspection Framework (EIF)", "Ofsted", "education", 0.9, [
        "Quality of education: intent, implementation, impact", "Behaviour and attitudes: expectations, attendance, bullying",
        "Personal development: character, SMSC, careers", "Leadership and management: vision, CPD, governance"]),
    ("AQA Assessment Objectives", "AQA Exam Board", "education", 0.6, [  # 0.95 for a-level or gcse intents
        "AO1: Demonstrate knowledge and understanding", "AO2: Apply knowledge to contexts",
        "AO3: Analyse and evaluate, make judgements", "AO4: Communicate using specialist vocabulary"]),
    ("Bloom's Taxonomy of Educational Objectives", "Academic framework", "education", 0.7, [
        "Lower order: Remember, Understand, Apply", "Higher order: Analyse, Evaluate, Create"]),
    ("CQC Fundamental Standards", "Care Quality Commission", "healthcare", 0.9, [
        "Regulation 9: Person-centred care", "Regulation 10: Dignity and respect", "Regulation 12: Safe care and treatment",
        "Regulation 13: Safeguarding", "Regulation 17: Good governance", "Regulation 20: Duty of candour"]),
    ("NICE Quality Standards", "National Institute for Health and Care Excellence", "healthcare", 0.8, [
        "Evidence-based clinical practice", "Measurable quality improvement", "Patient-centred outcome measures"]),
    ("HM Treasury Green Book", "HM Treasury", "government", 0.9, [
        "ROAMEF cycle compliance", "Options appraisal with counterfactual", "Cost-benefit analysis (CBA)",
        "Distributional analysis", "Risk and uncertainty assessment"]),
    ("Magenta Book: Guidance for Evaluation", "HM Treasury", "government", 0.8, [
        "Theory of change", "Counterfactual design", "Mixed methods approach", "Proportionate evaluation"]),
    ("Government Functional Standard GovS 013: Counter Fraud", "Cabinet Office", "government", 0.5, [
        "Counter fraud governance", "Fraud risk assessment", "Prevention and detection controls"]),
    ("UK GDPR and Data Protection Act 2018", "ICO / UK Government", "legal", 0.8, [
        "Lawful basis for processing", "Data minimisation and purpose limitation", "Data subject rights",
        "Data Protection Impact Assessment", "International transfer safeguards"]),
    ("Unfair Contract Terms Act 1977 / Consumer Rights Act 2015", "UK Legislation", "legal", 0.7, [
        "Transparency of terms", "Fair balance between parties", "No exclusion of statutory rights",
        "Reasonable limitation clauses"]),
    ("ESRC Research Ethics Framework", "Economic and Social Research Council", "research", 0.85, [
        "Informed consent", "Anonymisation and confidentiality", "Avoidance of harm", "Research independence",
        "Data management plan"]),
]


def framework_rows():
    """(framework_id, framework_name, pass_mark, criterion_no, criterion_id, title, description, max_score, weight)"""
    return [
        (fid, name, mark, i, *c)
        for fid, (name, _total, mark, crits) in FRAMEWORKS.items()
        for i, c in enumerate(crits)
    ]


def framework_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        framework_rows(),
        "framework_id string, framework_name string, pass_mark double, criterion_no int,"
        " criterion_id string, title string, description string, max_score double, weight double",
    )


def panel_rows():
    return [
        (dom, i, f"{dom}_{i}", *m)
        for dom, members in PANELS.items()
        for i, m in enumerate(members + [MODERATOR])
    ]


def panel_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        panel_rows(), "domain string, agent_no int, agent_id string, name string, role string, expertise string")


def panel_trust(panel: DataFrame) -> DataFrame:
    """Trust of every member towards every other member of the same (small) panel."""
    members = F.collect_list(F.struct("agent_id", F.col("role").alias("role")))
    by_domain = panel.groupBy("domain").agg(members.alias("members"))
    return (
        panel.join(by_domain, "domain")
        .select("domain", F.col("agent_id").alias("truster"), "role", F.explode("members").alias("m"))
        .where("truster <> m.agent_id")
        .select(
            "domain", "truster", F.col("m.agent_id").alias("trustee"), F.col("m.role").alias("trust_domain"),
            F.when(F.col("role") == MODERATOR[1], TRUST_FROM_MODERATOR).otherwise(TRUST_FROM_MEMBER).alias("trust_level"),
        )
    )


def guideline_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(i, *g) for i, g in enumerate(GUIDELINES)],
        "guideline_no int, title string, source string, sector string, relevance double, key_criteria array<string>")
