"""Panel forecasting and portfolio analytics as DataFrame jobs."""
