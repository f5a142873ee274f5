"""Texts sent to models and judges.

Fixed values: wording and layout are part of the contract and must stay as they are.
``<<name>>`` marks a place that a column fills.
"""

SYSTEM_TEXT = {
    "code": "Only return valid Python code. No markdown or text.",
    "text": "Answer clearly and concisely.",
}

TEXT_JUDGE_HEAD = """You are an expert evaluator. Given the following prompt:

            PROMPT:
            <<prompt>>

            And the following model responses:

            """

TEXT_JUDGE_SECTION = """<<model>>:
<<response>>

"""

TEXT_JUDGE_TASK = """
            Score each response on a scale of 1–5 for:
            - Correctness: How accurate and factually correct is the response?
            - Relevance: How well does the response address the prompt?

            Then select the best response and provide detailed reasoning.

            Return the output in **this exact JSON format**:

            {
"""

TEXT_JUDGE_ENTRY = """            "<<model>>": { 
                "correctness": <<correctness>>, 
                "relevance": <<relevance>>,
                "reasoning": "Detailed explanation of strengths and weaknesses"
            },
"""

TEXT_JUDGE_TAIL = """            "winner": "<<winner>>",
            "winner_reasoning": "Detailed explanation of why this response is the best",
            "loser_reasoning": "Detailed explanation of why the losing response fell short"
            }

            For the reasoning fields:
            - Be specific about what makes each response good or bad
            - Point out specific strengths and weaknesses
            - Explain how well each response addresses the prompt
            - Highlight any factual errors, logical gaps, or missed points

            Only return valid JSON."""

CODE_JUDGE_HEAD = """
You are an expert code evaluator. Given the following prompt:

PROMPT:
<<prompt>>

And the following model responses with their evaluation results:

"""

CODE_JUDGE_SECTION = """
<<model>>:
CODE:
<<response>>

EVALUATION RESULTS:
- Status: <<status>>
- Final Score: <<score>>
- Tests: <<tests>>
- Style Score: <<style_score>>
- Pylint Score: <<pylint_score>>
- Complexity: <<complexity>>
- Security Issues: <<issues>>

"""

CODE_JUDGE_TASK = """
Analyze each code submission and provide detailed reasoning about:
1. Code quality and readability
2. Test performance and edge case handling
3. Security considerations
4. Style and maintainability
5. Overall strengths and weaknesses

Return your analysis in this exact JSON format:

{
"""

CODE_JUDGE_ENTRY = """  "<<model>>": {
    "code_quality": "Detailed analysis of code structure and readability",
    "test_performance": "Analysis of how well the code handles edge cases",
    "security_analysis": "Security considerations and potential issues",
    "style_assessment": "Code style, maintainability, and best practices",
    "strengths": "List of specific strengths",
    "weaknesses": "List of specific weaknesses"
  },
"""

CODE_JUDGE_TAIL = """  "winner": "model_name",
  "winner_reasoning": "Detailed explanation of why this code is the best",
  "loser_reasoning": "Detailed explanation of why the losing code fell short"
}

Only return valid JSON.
"""

TEST_WRITER = """
You are an expert test writer. Given the prompt:
<<prompt>>

And this Python function:
<<code>>

Write a concise test function with exactly 10 test cases (5 valid, 5 invalid) that test key edge cases.
CRITICAL REQUIREMENTS:
- Do NOT include any import statements
- Do NOT include any markdown formatting (no ```python or ```)
- Keep it very concise - maximum 10 test cases total
- Return only the test function content
- Focus on the most important edge cases
- Start with "def test_" followed by a descriptive name

Example structure:
def test_function_name():
    # 5 valid cases
    assert function_call('valid_input') == expected_output
    assert function_call('another_valid') == expected_output
    
    # 5 invalid cases  
    assert function_call('invalid_input') == expected_output
    assert function_call('another_invalid') == expected_output

Return ONLY the test function definition and body, no imports, no markdown, exactly 10 test cases.
"""
