"""Column expressions: text, domains, Unicode, instructions, requests, document layers."""
