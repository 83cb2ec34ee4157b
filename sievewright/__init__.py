"""Text guardrail analytics as DataFrame transformations."""
