"""Planning helpers: durable intermediates and driver loops."""
