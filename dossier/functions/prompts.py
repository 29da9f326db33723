"""Prompt and training-record templates as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Record separators, chat tags and prompt texts.
END_OF_TEXT = "<|endoftext|>"
SYSTEM_TAG, USER_TAG, ASSISTANT_TAG, END_TAG = "<|system|>\n", "<|user|>\n", "<|assistant|>\n", "<|end|>\n"
RULE_EXPERT = (
    "You are an expert Java developer helper. You explain Java linting rules and provide examples."
)
JUDGE_HEAD = (
    "You are a classifier.\n\n"
    "Decide whether the following user question is related to Python programming or not.\n\n"
    'Question: "'
)
JUDGE_TAIL = '"\n\nRespond with just "yes" or "no".'
REFUSAL = (
    "❌ This assistant only supports **Python-related** queries. "
    "Please ask something about Python."
)
JUDGED_REFUSAL = (
    "❌ Only Python-related questions are allowed. "
    "Please ask something related to Python programming."
)
ROUTER_PROMPT = """You are a query router. Classify the user query into ONE of these categories:
            - 'factual': Simple factual questions that need direct information lookup
            - 'analytical': Questions requiring analysis, comparison, or synthesis of information
            - 'complex': Multi-part questions or questions requiring step-by-step reasoning
            
            Respond with ONLY the category name, nothing else."""
AGENT_PROMPTS = {
    "conversational": """You are a friendly assistant specialized in Medical Device Software Lifecycle
        Risk Management procedures. You're here to help users understand the document.
        Keep responses warm and professional.""",
    "factual_agent": """You are a factual information specialist for Medical Device Software Lifecycle
        Risk Management procedures.
        
        Context from the document:
        {context}
        
        Provide direct, accurate answers based strictly on the context provided.
        If the information is not in the context, clearly state that.""",
    "analytical_agent": """You are an analytical specialist for Medical Device Software Lifecycle
        Risk Management procedures.
        
        Context from the document:
        {context}
        
        Analyze the information, identify patterns, compare different aspects, and provide
        insightful synthesis. Structure your response clearly with reasoning.""",
    "complex_agent": """You are a complex reasoning specialist for Medical Device Software Lifecycle
        Risk Management procedures.
        
        Context from the document:
        {context}
        
        Break down complex questions into steps. Provide thorough, step-by-step reasoning.
        Show your thought process clearly.""",
}


def with_end_of_text(text: Column, marker: str = END_OF_TEXT) -> Column:
    return F.concat(text, F.lit(marker))


def rule_record(rule_id: Column, title: Column, description: Column) -> Column:
    return F.concat(
        F.lit("Rule ID: "), rule_id, F.lit("\nTitle: "), title,
        F.lit("\nDescription: "), description, F.lit(f"\n{END_OF_TEXT}\n"),
    )


def _rule_question(title: Column) -> Column:
    return F.concat(
        F.lit(f"{SYSTEM_TAG}{RULE_EXPERT}{END_TAG}{USER_TAG}How do I solve the Java rule: "),
        title,
        F.lit(f"?{END_TAG}{ASSISTANT_TAG}"),
    )


def rule_chat(title: Column, description: Column, examples: Column) -> Column:
    """Chat-template training text of one rule."""
    return F.concat(
        _rule_question(title), description, F.lit("\n\nExamples:\n"), examples, F.lit(END_TAG)
    )


def rule_prompt(title: Column) -> Column:
    """Chat-template prompt that leaves the answer open."""
    return _rule_question(title)


def assistant_answer(response: Column) -> Column:
    """What follows the last assistant tag, or everything when there is none."""
    return F.substring_index(response, ASSISTANT_TAG, -1)


def title_prompt(title: Column) -> Column:
    return F.concat(F.lit("Title: "), title, F.lit("\nDescription:"))


def summary_input(text: Column, characters: int = 100) -> Column:
    return F.concat(F.lit("Process: "), F.substring(text, 1, characters))


def judge_prompt(question: Column) -> Column:
    return F.concat(F.lit(JUDGE_HEAD), question, F.lit(JUDGE_TAIL))


def router_prompt(question: Column) -> Column:
    """System text and question for the model that names the question's class."""
    return F.concat(F.lit(f"system: {ROUTER_PROMPT}\nuser: "), question)


def agent_system_text(route: Column, context: Column) -> Column:
    """System text of the routed agent with the context filled in."""
    pairs = [F.lit(x) for pair in AGENT_PROMPTS.items() for x in pair]
    template = F.try_element_at(F.create_map(*pairs), route)
    return F.replace(template, F.lit("{context}"), F.coalesce(context, F.lit("")))


def chat_turn(role: Column, text: Column) -> Column:
    """One message in the chat template."""
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit(END_TAG))


def agent_prompt(route: Column, context: Column, history: Column, query: Column) -> Column:
    """System text, earlier messages and the question, as one text."""
    said = F.transform(history, lambda m: F.concat(m["role"], F.lit(": "), m["content"]))
    return F.array_join(
        F.concat(
            F.array(F.concat(F.lit("system: "), agent_system_text(route, context))),
            F.coalesce(said, F.array().cast("array<string>")),
            F.array(F.concat(F.lit("user: "), query)),
        ),
        "\n",
    )


def prompt_text(payload: Column) -> Column:
    """The question of a request given as ``struct(input, messages, text)``."""
    last = F.try_element_at(payload["messages"], F.lit(-1))["content"]
    return F.coalesce(payload["input"], F.when(F.size(payload["messages"]) > 0, last), payload["text"], F.lit(""))
