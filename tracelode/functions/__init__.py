"""Column functions by name, for use in DataFrame code; see operators for what each does."""

from tracelode.operators.book import pair_key, split_key, unit_hash
from tracelode.operators.docstore import canonical, checksum, compile_filter, violations
from tracelode.operators.evaluate import close, outcome
from tracelode.operators.speech import equal as speech_equal
from tracelode.operators.speech import first_sentence, sentences
from tracelode.operators.textops import (
    accepted, api_names, instructions, last_code_block, negated, placeholder, prompt, response_text, safe_tag, strip_fence, token_limit_error, value_type, variable_names, without_exit,
)

__all__ = [
    "accepted", "api_names", "canonical", "checksum", "close", "compile_filter", "first_sentence", "instructions", "last_code_block", "negated", "outcome", "pair_key", "placeholder", "prompt", "response_text",
    "safe_tag", "sentences", "speech_equal", "split_key", "strip_fence", "token_limit_error", "unit_hash", "value_type", "variable_names", "violations", "without_exit",
]
