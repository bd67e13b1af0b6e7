"""The method has no streaming source, watermark or stateful operator, so this package is empty."""
