-- Revenue over all orders beside the complaint rate over distinct (seller, review) pairs.
WITH seller_orders AS (
  SELECT seller_id, order_id, sum(price) AS revenue FROM star_items GROUP BY seller_id, order_id
),
revenue AS (
  SELECT seller_id, count(*) AS total_orders, round(CAST(sum(revenue) AS DOUBLE), 2) AS total_revenue
  FROM seller_orders GROUP BY seller_id
),
complaints AS (
  SELECT s.seller_id, count(*) AS text_reviews,
         round(avg(if(r.sentiment_label = 'Negative', 1D, 0D)), 4) AS negative_sentiment_rate
  FROM seller_orders AS s JOIN star_reviews AS r USING (order_id)
  GROUP BY s.seller_id
  HAVING count(*) >= :seller_min
)
SELECT seller_id, total_orders, total_revenue, text_reviews, negative_sentiment_rate
FROM revenue JOIN complaints USING (seller_id)
ORDER BY negative_sentiment_rate DESC, text_reviews DESC, seller_id
