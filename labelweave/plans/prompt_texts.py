"""The system prompts that the record queries must produce, spelled out, so that the
oracles do not call the code under test."""

STANDARD = """Task: Label every dimension of the codebook.

Definitions:
1) china_stance_score: Overall stance of the item, -1 to 1.
2) china_sensitive: Whether the item touches politically sensitive topics.
3) collective_action: Whether the item shows or calls for collective action.

Label the item on 3 dimensions:
1) china_stance_score: a number in [-1, 1]
2) china_sensitive: 'yes' | 'no' | 'cannot_determine'
3) collective_action: 'yes' | 'no' | 'cannot_determine'

Answer with one minified JSON object with the keys: china_stance_score, china_sensitive, collective_action."""

BY_CATEGORY = {
    "A": """Task: Decide whether the item is on topic and label its stances.

Definitions:
1) china_related: Whether the item is related to the topic at all.
2) china_ccp_government: Stance of the item toward the government.
3) china_people_culture: Stance of the item toward the people and culture.
4) china_technology_development: Stance of the item toward technology and development.

Label the item on 4 dimensions:
1) china_related: 'yes' | 'no'
2) china_ccp_government: 'pro' | 'anti' | 'neutral/unclear'
3) china_people_culture: 'pro' | 'anti' | 'neutral/unclear'
4) china_technology_development: 'pro' | 'anti' | 'neutral/unclear'

Answer with one minified JSON object with the keys: china_related, china_ccp_government, china_people_culture, china_technology_development.""",
    "B": """Task: Label political sensitivity and collective action.

Definitions:
1) china_sensitive: Whether the item touches politically sensitive topics.
2) collective_action: Whether the item shows or calls for collective action.

Label the item on 2 dimensions:
1) china_sensitive: 'yes' | 'no' | 'cannot_determine'
2) collective_action: 'yes' | 'no' | 'cannot_determine'

Answer with one minified JSON object with the keys: china_sensitive, collective_action.""",
    "C": """Task: Label hate speech and harmful content.

Definitions:
1) hate_speech: Whether the item contains hate speech.
2) harmful_content: Whether the item contains harmful content.

Label the item on 2 dimensions:
1) hate_speech: 'yes' | 'no' | 'cannot_determine'
2) harmful_content: 'yes' | 'no' | 'cannot_determine'

Answer with one minified JSON object with the keys: hate_speech, harmful_content.""",
    "D": """Task: Label the type and authenticity of the item.

Definitions:
1) news_segments: Whether the item contains news segments.
2) inauthentic_content: Whether the item is inauthentic.
3) derivative_content: Whether the item is derivative of other content.

Label the item on 3 dimensions:
1) news_segments: 'yes' | 'no' | 'cannot_determine'
2) inauthentic_content: 'yes' | 'no' | 'cannot_determine'
3) derivative_content: 'yes' | 'no' | 'cannot_determine'

Answer with one minified JSON object with the keys: news_segments, inauthentic_content, derivative_content.""",
}

# one dimension alone: singular wording, numeric formats, images
HATE_NUMERIC_VISION = """The item comes with video frames; use them with the text.

Task: Label Hate speech.

Definitions:
1) hate_speech: Whether the item contains hate speech.

Score the item on 1 dimension:
1) hate_speech: a number in [0, 1]

Answer with one minified JSON object with the key: hate_speech."""
