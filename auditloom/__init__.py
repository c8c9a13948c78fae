"""Technical website audits as DataFrame plans."""
